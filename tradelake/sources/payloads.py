"""Nested business payloads: one record per row, as JSON text or as VARIANT.

A payload is parsed once into a VARIANT, which keeps decimals exact, and read by
path. Scalars are taken as text and cast when the table's columns are made, so
money never passes through a float and a value of the wrong type is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MEMBERS, ITEMS = "map<string,variant>", "array<variant>"

# What stands for an absent object or list.
ABSENT = ("null", '""', "[]", "{}", "false", "0")


def read_payloads(spark: SparkSession, path: str, envelope: str = "response") -> DataFrame:
    """Records of JSON files, one document per line, as a VARIANT column `payload`.

    A document is an object with a list of records under `envelope`, or one
    record. Files are split over tasks.
    """
    docs = spark.read.option("singleVariantColumn", "doc").json(path)
    many = F.try_variant_get("doc", f"$.{envelope}", ITEMS)
    return docs.select(F.explode(F.coalesce(many, F.array("doc"))).alias("payload"))


class PayloadArchive:
    """Payloads of one kind by id, parsed, in folders by a bucket of the id.

    Looking up ids reads the folders of their buckets only. Buckets should hold
    up to about a gigabyte.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("id").cast("bigint")), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, payloads: DataFrame) -> None:
        """Append (id, raw_payload) texts; ids must not repeat.

        Only the texts are shuffled and sorted: they are parsed where they are written.
        """
        moved = payloads.select("id", "raw_payload", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "id")
        moved.select("id", "raw_payload", F.parse_json("raw_payload").alias("payload"), "bucket").write.mode("append").partitionBy(
            "bucket").parquet(self.path)

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, raw_payload, payload) of those ids that are there."""
        found = [r[0] for r in ids.select(self._bucket()).distinct().collect()]  # at most `buckets` numbers
        rows = self.spark.read.schema("id BIGINT, raw_payload STRING, payload VARIANT, bucket INT").parquet(self.path)
        return rows.filter(F.col("bucket").isin(found)).drop("bucket").join(ids, "id", "left_semi")


def parse(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the payload as a VARIANT `p`, parsed once per row.

    Text that is no JSON is an error. A generator keeps the parse from being
    repeated for each column made of it.
    """
    if isinstance(df.schema["payload" if "payload" in df.columns else "raw_payload"].dataType, T.VariantType):
        given = F.col("payload" if "payload" in df.columns else "raw_payload")
    else:
        given = F.parse_json("raw_payload")
    return df.select(*keep, F.explode(F.array(given)).alias("p"))


def text(path: str, of: str = "p") -> Column:
    """The value at a path as text: scalars as they are, anything else as JSON text."""
    return F.variant_get(of, _path(path), "string")


def members(path: str, of: str = "p") -> Column:
    """An object as a map of VARIANTs; NULL for anything else."""
    return F.try_variant_get(of, _path(path), MEMBERS)


def items(path: str, of: str = "p") -> Column:
    """A list of VARIANTs; NULL for anything else."""
    return F.try_variant_get(of, _path(path), ITEMS)


def present(path: str, of: str = "p") -> Column:
    """The value at a path as JSON text; NULL for an absent one."""
    found = F.to_json(F.variant_get(of, _path(path), "variant"))
    return F.when(~found.isin(*ABSENT), found)


def shaped(df: DataFrame, objects: tuple[str, ...] = (), lists: tuple[str, ...] = (), of: str = "p") -> DataFrame:
    """df, checked: what stands at certain paths is an object, or a list, or absent.

    An object is named by the path of one of its members, usually there, which
    proves it cheaply: "a.b" for an object `a`, "id" for the record itself, "a."
    if no member is known. Whether an empty value stands for an absent object is
    so decided by its path: under a free key the same value stays what it is.
    """

    def problem(path: str, first: Column | None, whole: Column, kind: str) -> Column:
        odd = whole.isNull() & present(path, of).isNotNull()
        return F.when(odd if first is None else first.isNull() & odd, F.lit(f"{path or 'record'}: no {kind}"))

    def at(path: str) -> Column:
        return F.variant_get(of, _path(path), "variant")

    found = []
    for path in objects:
        parent, _, member = path.rpartition(".")
        found.append(problem(parent, at(path) if member else None, members(parent, of), "object"))
    found += [problem(path, at(f"{path}[0]"), items(path, of), "list") for path in lists]
    return _refused(df, found)


def _refused(df: DataFrame, problems: list[Column]) -> DataFrame:
    """df; a record with a problem is an error."""
    first = F.coalesce(*problems)
    return df.filter(F.when(first.isNotNull(), F.raise_error(first).cast("boolean")).otherwise(F.lit(True)))


class Members:
    """Texts of a record by path, all read in one pass over it.

    Columns are made by `text`; `over` then adds what they are made of to the
    record's frame. Looking up one path after another would compare the names
    of a record's members anew for each.
    """

    def __init__(self, of: str = "p"):
        self.of, self.column, self._kinds = of, f"{of}_members", {}

    def _at(self, path: str) -> Column:
        found = F.col(self.column)
        for name in filter(None, path.split(".")):
            found = found.getField(name.removesuffix("[0]"))
            found = F.get(found, F.lit(0)) if name.endswith("[0]") else found
        return found

    def text(self, path: str) -> Column:
        """The value at a path as text; steps are names, or names and [0]."""
        self._kinds[path] = "string"
        return self._at(path)

    def members(self, path: str) -> Column:
        """The object at a path as a map of VARIANTs."""
        self._kinds[path] = MEMBERS
        return self._at(path)

    def over(self, df: DataFrame, objects: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
        """df with the members, checked like `shaped`: an object is named by the path of a member that is read."""
        read = F.try_variant_get(self.of, "$", _members_type(dict.fromkeys(objects, "string") | self._kinds))
        df = df.select("*", F.explode(F.array(read)).alias(self.column))

        def problem(path: str, kind: str) -> Column:
            odd = self._at(path).isNull() & present(path, self.of).isNotNull()
            return F.when(odd, F.lit(f"{path or 'record'}: no {kind}"))

        parents = dict.fromkeys([*(o.rpartition(".")[0] for o in objects), *(p for p, k in self._kinds.items() if k == MEMBERS)])
        return _refused(df, [*(problem(p, "object") for p in parents), *(problem(p, "list") for p in lists)])


def _members_type(kinds: dict[str, str]) -> str:
    """The type that reads some paths of a record, each as its kind."""
    below: dict[str, dict[str, str]] = {}
    for path, kind in kinds.items():
        name, _, rest = path.partition(".")
        below.setdefault(name, {})[rest] = kind
    fields = []
    for name, rests in below.items():
        inner = {rest: kind for rest, kind in rests.items() if rest}
        kind = _members_type(inner) if inner else rests[""]
        fields.append(f"`{name.removesuffix('[0]')}`: " + (f"array<{kind}>" if name.endswith("[0]") else kind))
    return f"struct<{', '.join(fields)}>"


def _path(path: str) -> str:
    return f"$.{path}" if path and path[0] != "[" else f"${path}"
