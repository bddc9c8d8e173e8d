"""Amounts of money in a column: signs, marks and currencies, as expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How currencies are written.
CURRENCIES = {
    "EUR": ["€", "eur", "euro", "euros"],
    "USD": ["us$", "$", "usd", "dolar", "dolares", "dólar", "dólares", "dollar", "dollars"],
    "GBP": ["£", "gbp"],
    "CHF": ["chf", "sfr"],
    "SEK": ["sek"],
    "DKK": ["dkk"],
    "NOK": ["nok"],
    "PLN": ["pln", "zł"],
    "CZK": ["czk", "kč"],
    "JPY": ["jpy", "¥"],
    "MXN": ["mxn", "mx$"],
    "CAD": ["cad", "ca$", "c$"],
    "AUD": ["aud", "au$", "a$"],
    "BRL": ["brl", "r$"],
    "CNY": ["cny", "rmb"],
    "INR": ["inr", "₹"],
    "ARS": ["ars"],
    "HUF": ["huf"],
    "RON": ["ron"],
    "TRY": ["₺"],
}
#: Currencies whose decimal mark is a point.
POINT_CURRENCIES = ["USD", "GBP", "CHF", "JPY", "MXN", "CAD", "AUD", "CNY", "INR"]
CODES = {written: code for code, all_written in CURRENCIES.items() for written in all_written}


def _marks() -> str:
    """An expression for one currency, longer ones first; words aren't parts of longer words."""
    def one(written: str) -> str:
        bare = "".join(f"[{c}]" if c == "$" else c for c in written)
        return ("(?<![A-Za-z])" if written[0].isalpha() else "") + bare + ("(?![A-Za-z])" if written[-1].isalpha() else "")

    return "(?i)(?u)(" + "|".join(one(w) for w in sorted(CODES, key=len, reverse=True)) + ")"


MARKS = _marks()


def quoted(text: str) -> str:
    """A string as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _then(steps: list[str], first: str) -> str:
    """SQL that goes from step to step (``x -> expression``), each over an array of one, so that none is written or done twice."""
    out = f"array({first})"
    for step in steps:
        out = f"transform({out}, {step})"
    return f"{out}[0]"


def cents_sql(text: str, mark: str) -> str:
    """SQL for the cents of an amount: null where the text is more than an amount and its currency.

    ``mark`` is ``,``, ``.`` or null. Without it the last of two different marks is decimal; one mark that stands several times groups digits; one before
    three digits groups them too, unless it's a point and the currency's mark is the point; else it's decimal. Groups have three digits. Parentheses and a minus in front or behind mean less than nothing.
    """
    points = ", ".join(quoted(w) for w, code in CODES.items() if code in POINT_CURRENCIES)
    shape = lambda d, t: f"concat('^(?:[0-9]*|[0-9]{{1,3}}(?:', {t}, '[0-9]{{3}})+)(?:', {d}, '[0-9]*)?$')"
    steps = [
        f"t -> struct(regexp_replace(regexp_replace(t, {quoted(MARKS)}, ''), {quoted(chr(92) + 's|[’' + chr(39) + ']')}, '') AS s, lower(regexp_extract(t, {quoted(MARKS)}, 1)) IN ({points}) AS dot)",
        "x -> struct(rlike(x.s, '^[(].*[)]$') AS n, regexp_replace(regexp_replace(x.s, '^[(](.*)[)]$', '$1'), '^[+]', '') AS s, x.dot AS dot)",
        "x -> struct(x.n <> (rlike(x.s, '^[-−–]') OR rlike(x.s, '-$')) AS n, CASE WHEN rlike(x.s, '^[-−–]') THEN substring(x.s, 2) ELSE regexp_replace(x.s, '-$', '') END AS s, x.dot AS dot)",
        f"""x -> struct(x.n AS n, x.s AS s, CASE WHEN {mark} IS NOT NULL THEN {mark} WHEN contains(x.s, ',') AND contains(x.s, '.') THEN regexp_extract(x.s, '([.,])[0-9]*$', 1)
            WHEN rlike(x.s, '[.,][0-9]*[.,]') THEN '' WHEN rlike(x.s, '^[1-9][0-9]{{0,2}},[0-9]{{3}}$') OR rlike(x.s, '^[1-9][0-9]{{0,2}}[.][0-9]{{3}}$') AND NOT x.dot THEN '' ELSE regexp_extract(x.s, '[.,]', 0) END AS d)""",
        "x -> struct(x.n AS n, x.s AS s, x.d AS d, CASE WHEN x.d = ',' THEN '.' WHEN x.d = '.' THEN ',' ELSE regexp_extract(x.s, '[.,]', 0) END AS g)",
        f"""x -> CASE WHEN rlike(x.s, '[0-9]') AND rlike(x.s, CASE WHEN x.d = '' AND x.g = '' THEN '^[0-9]+$' WHEN x.d = '' THEN concat('^[0-9]{{1,3}}(?:[', x.g, '][0-9]{{3}})+$') ELSE {shape("'[' || x.d || ']'", "'[' || x.g || ']'")} END)
            THEN CAST(round(try_cast(replace(CASE WHEN x.g = '' THEN x.s ELSE replace(x.s, x.g, '') END, ',', '.') AS DECIMAL(28, 8)) * 100, 0) AS BIGINT) * CASE WHEN x.n THEN -1 ELSE 1 END END""",
    ]
    return _then(steps, text)


def parse_amounts(rows: DataFrame, col: str, group: str) -> DataFrame:
    """Adds ``cents`` (:func:`cents_sql`). The values of a group vote for its decimal mark: a mark before one or two last digits, and the last of two in the right order; a group without votes has none, and each value speaks for itself."""
    bare = F.regexp_replace(F.regexp_replace(F.col(col), MARKS, ""), r"\s", "")
    counts = [("_comma", r",[0-9]{1,2}$"), ("_comma2", r"[.][0-9]{3},[0-9]+$"), ("_point", r"[.][0-9]{1,2}$"), ("_point2", r",[0-9]{3}[.][0-9]+$")]
    votes = rows.groupBy(F.col(group).alias("_group")).agg(*[F.count_if(bare.rlike(form)).alias(name) for name, form in counts])
    comma, point = F.col("_comma") + F.col("_comma2"), F.col("_point") + F.col("_point2")
    votes = votes.select("_group", F.when(comma + point == 0, None).when(comma >= point, ",").otherwise(".").alias("_mark"))
    return rows.join(votes, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_text", F.col(col)).withColumn("cents", F.expr(cents_sql("_text", "_mark"))).drop("_group", "_mark", "_text")
