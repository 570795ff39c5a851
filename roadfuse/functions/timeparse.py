"""ISO-8601 timestamps with a mandatory zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual shape, which Spark casts directly.
_USUAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})\z"
# Everything else that is accepted: basic forms, week dates, any separator, short times,
# long or comma fractions, offsets down to seconds.
_GENERAL = (
    r"\A(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-?W(\d{2})(?:-?(\d))?)"
    r"(?s:.)"
    r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:Z|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?)\z"
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _general(ts: Column) -> Column:
    # One match rewrites the text to its groups, separated by bars.
    groups = F.split(F.regexp_replace(ts, _GENERAL, "|".join(f"${i}" for i in range(1, 18))), "\\|")

    def moment(g: Column) -> Column:
        def part(i: int) -> Column:
            return g[i - 1]

        def num(i: int) -> Column:
            # Guarded, because a cast that fails is far slower than one that is not tried.
            return F.when(part(i) != "", part(i).cast("int"))

        def or_zero(i: int) -> Column:
            return F.coalesce(num(i), F.lit(0))

        year = F.coalesce(num(1), num(4), num(7))
        fourth = F.make_date(year, F.lit(1), F.lit(4))
        monday = F.date_add(F.trunc(fourth, "week"), (num(8) - 1) * 7)
        # A week 53 only exists where its Thursday still belongs to the year.
        week_ok = num(8).between(1, 53) & or_zero(9).between(0, 7) & (F.year(F.date_add(monday, 3)) == year)
        by_week = F.when(week_ok & (part(9) != "0"), F.date_add(monday, F.coalesce(num(9), F.lit(1)) - 1))
        digits = F.concat_ws("-", *[F.concat(part(a), part(b)) for a, b in ((1, 4), (2, 5), (3, 6))])
        micros = F.when(part(13) != "", F.rpad(F.substring(part(13), 1, 6), 6, "0").cast("long")).otherwise(0)
        clock = (or_zero(10) * 3600 + or_zero(11) * 60 + or_zero(12)).cast("long") * 1_000_000 + micros
        offset = (or_zero(15) * 3600 + or_zero(16) * 60 + or_zero(17)).cast("long") * 1_000_000
        in_range = (year >= 1) & (or_zero(10) < 24) & (or_zero(15) < 24)
        for i in (11, 12, 16, 17):
            in_range = in_range & (or_zero(i) < 60)
        day = F.when(num(8).isNotNull(), by_week).otherwise(digits.try_cast("date"))
        shift = F.when(part(14) == "-", -offset).otherwise(offset)
        return F.when(in_range, F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000 + clock - shift))

    return _let(groups, moment)


def parse_iso(ts: Column) -> Column:
    """The instant, or NULL where the text is not ISO-8601 with a zone."""
    return F.when(ts.rlike(_USUAL) & ~ts.startswith("0000"), ts.try_cast("timestamp")).when(
        ts.rlike(_GENERAL), _general(ts)
    )
