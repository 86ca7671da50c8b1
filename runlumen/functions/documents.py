"""JSON expressions: canonical text, nesting depth, strict verdicts and digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# one JSON string, closed or running to the end; possessive loops keep Java's matcher iterative
_STRING = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)'


def sha256(value: Column) -> Column:
    """Lower-case hex SHA-256 of bytes or UTF-8 text."""
    return F.sha2(value, 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact ASCII JSON object with sorted keys and explicit nulls."""
    ordered = F.struct(*(value.alias(name) for name, value in sorted(fields.items())))
    return F.to_json(
        ordered,
        {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true",
         "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat":
         "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )


def json_depth(text: Column) -> Column:
    """Largest bracket depth outside strings; a closing bracket at depth zero is ignored.

    Strings go first, then everything that is no bracket, so the fold only walks over brackets.
    """
    brackets = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]+", "")
    steps = F.split(brackets, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(acc: Column, c: Column) -> Column:
        depth = (
            F.when(c.isin("[", "{"), acc["depth"] + 1)
            .when(c.isin("]", "}"), F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        return F.struct(depth.alias("depth"), F.greatest(acc["deepest"], depth).alias("deepest"))

    return F.aggregate(steps, start, step, lambda acc: acc["deepest"])


def strict_verdict(raw: Column) -> Column:
    """OK, INVALID, DUPLICATE_KEY or NESTING_LIMIT_EXCEEDED per document of bytes.

    Spark's JSON functions accept trailing text and cannot tell a repeated key from bad syntax, so
    this one decision uses the standard decoder in Arrow batches; nothing but the code comes back.
    Everything the function needs is local to it, so executors need no copy of this package.
    """

    def judge(content: pd.Series) -> pd.Series:
        import json

        class RepeatedKey(Exception):
            pass

        def unique(pairs):
            found = dict(pairs)
            if len(found) != len(pairs):
                raise RepeatedKey
            return found

        def refuse(constant):
            raise ValueError(constant)

        def verdict(document):
            if document is None:
                return None
            try:
                value = json.loads(
                    bytes(document).decode("utf-8"), object_pairs_hook=unique,
                    parse_constant=refuse)
            except RepeatedKey:
                return "DUPLICATE_KEY"
            except RecursionError:
                return "NESTING_LIMIT_EXCEEDED"
            except ValueError:
                return "INVALID"
            return "OK" if isinstance(value, dict) else "INVALID"

        return content.map(verdict)

    return F.pandas_udf(judge, T.StringType())(raw)


def digest_words(hex_digest: Column) -> list[Column]:
    """Eight 32-bit words of a SHA-256."""
    return [
        F.conv(F.substring(hex_digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)
    ]


def set_digest(hex_digest: Column) -> Column:
    """Aggregate: digest of a multiset of member digests, independent of order.

    Word-wise sums of the member digests (the additive multiset hash of Clarke et al., 2003) are
    partial aggregates, so a group of any size is combined before the shuffle and never collected.
    """
    sums = [F.coalesce(F.sum(w), F.lit(0)) for w in digest_words(hex_digest)]
    return F.sha2(F.concat_ws("|", F.count(hex_digest), *sums), 256)
