"""The registered queries and, beside each, the SQL that checks it."""
