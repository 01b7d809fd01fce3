"""Learned parsers as a table function: a text in, any number of rows out, with columns that the call itself names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StringType, StructType

#: What a learned parser is: the text and a hint in, one dict of strings for each record out.
Parser = Callable[[str, str | None], list[dict[str, str | None]]]


def register_parser(spark: SparkSession, name: str, parser: Parser) -> None:
    """Makes a parser a table function of SQL: name(text, 'column, column ...' [, hint]).

    The columns, all strings, are analysed when the query is: they must be a constant. Keys are matched in any case; a key
    that a record has not got is null, others are passed over. A null text has no records. A text that the parser raises an
    error on has none either, as one odd text must not end a landing; the row `_error` column, if asked for, then says why.
    """

    class Learned:
        @staticmethod
        def analyze(text: AnalyzeArgument, columns: AnalyzeArgument, hint: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not columns.isConstantExpression or not columns.value:
                raise ValueError("name the columns in a constant, with commas between them")
            schema = StructType()
            for c in str(columns.value).split(","):
                schema.add(c.strip(), StringType())
            return AnalyzeResult(schema=schema)

        def eval(self, text: str | None, columns: str, hint: str | None = None) -> Iterator[tuple]:  # noqa: A003
            names = [c.strip().lower() for c in columns.split(",")]
            if text is None:
                return
            try:
                rows = parser(text, hint)
            except Exception as e:  # noqa: BLE001  (any fault of a learned parser)
                rows = [{"_error": f"{type(e).__name__}: {e}"}] if "_error" in names else []
            for row in rows:
                low = {k.lower(): v for k, v in row.items()}
                yield tuple(None if low.get(n) is None else str(low[n]) for n in names)

    spark.udtf.register(name, udtf(Learned))


def parse_learned(raw: DataFrame, name: str, columns: list[str], text: str = "raw_output") -> DataFrame:
    """raw without its text, and the records that a registered parser finds in each text, joined laterally."""
    kept = ", ".join(f"r.`{c}`" for c in raw.columns if c != text)
    return raw.sparkSession.sql(f"SELECT {kept}, p.* FROM {{raw}} r, LATERAL {name}(r.`{text}`, '{', '.join(columns)}') p", raw=raw)  # noqa: S608
