"""Columns made from report remarks and station labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import fahrenheit

# Words that keep an inner capital, and the postal codes of states.
CASE_EXCEPTIONS = {"MACARTHUR": "MacArthur", "MACREADY": "MacReady", "MCALLEN": "McAllen", "MCAS": "MCAS", "MCCARRAN": "McCarran", "MCCOMB": "McComb", "MCCOOK": "McCook", "MCGRATH": "McGrath", "MCKELLAR": "McKellar", "MCMINNVILLE": "McMinnville", "MCNARY": "McNary", "DEKALB": "DeKalb"}
STATE_CODES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR".split()
CONTIGUOUS = [s for s in STATE_CODES if s not in ("AK", "HI", "PR")]

SEASON_WORDS = {"DJF": "winter", "MAM": "spring", "JJA": "summer", "SON": "fall"}
VARIABLE_WORDS = {"max": "Highs", "min": "Lows"}


def _matches(pattern: str):
    return lambda word: word.rlike(pattern)


def remark_groups(report: Column | str) -> dict[str, Column]:
    """The six-hour maximum and minimum (°F) that a report's remarks carry, and whether either is ambiguous.

    Groups are words after the first RMK: ``1`` (maximum) or ``2`` (minimum), a sign digit and
    tenths of °C. Equal repeats are one; different ones give null and a true flag, each for itself.
    """
    words = F.split(F.trim(F.col(report) if isinstance(report, str) else report), r"\s+")
    at = F.array_position(words, "RMK")
    remarks = F.when(at > 0, F.slice(words, at.cast("int") + 1, F.size(words)))
    out = {}
    for name, lead in (("max", "1"), ("min", "2")):
        got = F.array_distinct(F.filter(remarks, _matches(f"^{lead}[01][0-9]{{3}}$")))
        one = F.when(F.size(got) == 1, F.element_at(got, 1))
        sign = F.when(F.substring(one, 2, 1) == "1", -1.0).otherwise(1.0)
        out[f"{name}_6h_f"] = fahrenheit(sign * F.substring(one, 3, 3).cast("double") / 10.0)
        out[f"{name}_ambiguous"] = F.coalesce(F.size(got) > 1, F.lit(False))
    return out


def strict_groups(report: Column | str) -> dict[str, Column]:
    """As :func:`remark_groups`, but an ambiguous report is an error."""
    got = remark_groups(report)
    bad = lambda n: F.raise_error(F.lit(f"ambiguous six-hour {n}"))
    return {f"{n}_6h_f": F.when(got[f"{n}_ambiguous"], bad(n)).otherwise(got[f"{n}_6h_f"]) for n in ("max", "min")}


def ambiguity_reason(name: str, valid: Column | str) -> Column:
    """The gap reason of an ambiguous report, with its time of day."""
    v = F.col(valid) if isinstance(valid, str) else valid
    return F.concat(F.lit(f"ambiguous_six_hour_{name}@"), F.date_format(v, "HH:mm"))


def short_code(station: Column | str) -> Column:
    """A four-letter K station without its K; any other as it is."""
    s = F.col(station) if isinstance(station, str) else station
    return F.when((F.length(s) == 4) & s.startswith("K"), F.substring(s, 2, 3)).otherwise(s)


def label_case(label: Column | str, overrides: dict[str, str] | None = None) -> Column:
    """A station label in title case; what follows its last comma stays as it is.

    Letters after a non-letter become capitals. Words of ``CASE_EXCEPTIONS`` have their own
    spelling, and a state code that stands right before the last comma stays in capitals.
    ``overrides`` maps whole labels.
    """
    c = F.col(label) if isinstance(label, str) else label
    comma = F.instr(c, ",") > 0
    tail = F.when(comma, F.concat(F.lit(","), F.substring_index(c, ",", -1))).otherwise("")
    head = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    words = F.regexp_extract_all(head, F.lit(r"([^ /\-'.]+|[ /\-'.])"), F.lit(1))
    n = F.size(words)
    table = F.create_map(*[F.lit(x) for kv in CASE_EXCEPTIONS.items() for x in kv])

    def one(word: Column, i: Column) -> Column:
        runs = F.regexp_extract_all(word, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
        plain = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")
        state = comma & (i == n - 1) & F.upper(word).isin(STATE_CODES)
        return F.when(state, F.upper(word)).otherwise(F.coalesce(F.element_at(table, F.upper(word)), plain))

    cased = F.concat(F.array_join(F.transform(words, one), ""), tail)
    if overrides:
        fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        cased = F.coalesce(F.element_at(fixed, c), cased)
    return cased


def search_stations(df: DataFrame, text: str, n: int = 8, key: str = "station", label: str = "label") -> DataFrame:
    """The first ``n`` stations whose id or label holds ``text``, in id order; case does not matter."""
    t = text.strip().lower()
    return df.where(F.lower(key).contains(t) | F.lower(label).contains(t)).orderBy(key).limit(n)


def contiguous_states(df: DataFrame, state: str = "state") -> DataFrame:
    return df.where(F.col(state).isin(CONTIGUOUS))
