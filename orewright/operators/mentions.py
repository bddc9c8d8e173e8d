"""Dates and prices in running text. Each text is cut into small pieces and read from piece to piece, in Arrow batches; counts and sums are Spark's."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.operators.amounts import CODES, MARKS, POINT_CURRENCIES
from orewright.operators.text import ACCENTED, PLAIN

_FOLD = str.maketrans(ACCENTED, PLAIN)
#: A run of digits, of letters or of blanks, or one other character.
_PIECE = re.compile(r"[0-9]+|[^\W\d_ºª]+|\s+|.", re.S)

#: Names of the twelve months, without accents.
MONTHS = [
    "enero ene january jan janvier janv janeiro gennaio gen januar",
    "febrero feb february fevrier fevr fevereiro fev febbraio februar",
    "marzo mar march mars marco marz mrz",
    "abril abr april apr avril avr aprile",
    "mayo may mai maio maggio mag",
    "junio jun june juin junho giugno giu juni",
    "julio jul july juillet juil julho luglio lug juli",
    "agosto ago august aug aout",
    "septiembre setiembre sept sep set september septembre setembro settembre",
    "octubre oct october octobre outubro out ottobre ott oktober okt",
    "noviembre nov november novembre novembro",
    "diciembre dic december dec decembre dezembro dez dicembre dezember",
]
_MONTH = {name: i for i, names in enumerate(MONTHS, 1) for name in names.split()}
#: What follows the number of a day, and words between the parts of a date.
ORDINALS = ["st", "nd", "rd", "th", "o", "º", "°"]
OF, OF_YEAR = ["de", "of"], ["de", "del", "of"]
YEARS = range(1900, 2101)


def _each(*parts: str) -> list[str]:
    """All phrases with one of the alternatives (parted by ``|``; one may be empty) of each part."""
    return [" ".join(x for x in way if x) for way in product(*[p.split("|") for p in parts])]


#: Phrases before a date that say what it's for.
ROLES = {
    "due": [
        *_each("fecha", "|de|limite de", "vencimiento|pago|cargo|cobro|adeudo|domiciliacion"), "fecha limite", "vencimiento", *_each("vence", "|el"), *_each("pagar|pago", "antes", "de|del"), *_each("antes", "de|del"),
        *_each("se", "cargara|cobrara|adeudara|pasara al cobro", "|el|en su cuenta el"), *_each("proximo|siguiente", "cobro|cargo|pago|recibo"), "due date", "payment due", "due on", "pay by",
        *_each("next", "billing|billing date|payment|charge"), "billing date", *_each("pagar|pago|abonar", "hasta", "|el"),
    ],
    "expires": [
        *_each("valido|valida|vigente", "hasta"), *_each("fecha de", "caducidad|expiracion|validez"), "caducidad", *_each("caduca", "|el"), "validez", *_each("valid", "until|through"), *_each("expire|expires", "|on"),
        *_each("expiry|expiration", "|date"), "use by", "best before", *_each("consumir preferentemente antes", "de|del"), "hasta el",
    ],
    "issued": [
        *_each("fecha", "|de", "|la", "factura|emision|expedicion|edicion|documento|recibo"), "invoice date", "date of issue", "issue date", *_each("issued", "|on"), *_each("emitido|emitida|expedido|expedida", "|el"), "fecha", "date",
    ],
    "delivery": [
        *_each("fecha", "|estimada|prevista", "de entrega"), *_each("entrega", "|estimada|prevista|entre"), *_each("entregado|entregada", "el"), *_each("se entregara", "|el"), *_each("llegara|llega", "|el"), "llegada estimada",
        *_each("recibiras|recibelo", "|el"), *_each("delivered", "|on"), "delivery date", *_each("estimated|expected", "delivery"), *_each("arrive|arrives|arriving", "|on"),
    ],
    "departure": [
        *_each("fecha de", "salida|ida|viaje|inicio"), "salida", "salimos", *_each("sale", "|el"), *_each("departure", "|date"), *_each("depart|departs", "|on"), "departing", "outbound", "ida", "vuelo", "check-in", "checkin", "despega", "embarque", "start date",
    ],
    "return": [*_each("fecha de", "regreso|vuelta"), "regreso", "vuelta", *_each("return", "|date|on"), *_each("returns", "|on"), "inbound", "check-out", "checkout"],
    "purchase": [
        *_each("fecha de", "|la", "compra|venta|pedido|operacion|transaccion"), "fecha compra", "order date", *_each("date of", "purchase|order"), "purchase date", *_each("comprado|comprada", "el"), "pedido realizado el", "pedido del", "compra del",
        "ordered on", "purchased on",
    ],
    "renewal": ["proxima renovacion", "fecha de renovacion", "renovacion", *_each("se renovara", "|el|automaticamente el"), *_each("renew|renews", "|on|automatically on"), "renewal date", "next renewal", "prorroga"],
}
#: On which side of today a date of a role lies, how far before it a phrase may begin and end.
SIDES = {"due": 1, "expires": 1, "issued": -1, "delivery": 1, "departure": 1, "return": 1, "purchase": -1, "renewal": 1, "": 0}
LABEL_WINDOW, LABEL_GAP = 80, 24


def _pieces(text: str) -> list[tuple[int, str]]:
    """Where each piece begins, and the piece; all blanks are one."""
    return [(m.start(), " " if m[0].isspace() else m[0]) for m in _PIECE.finditer(text)]


#: Phrases by their last piece.
_PHRASES: dict[str, list[tuple[list[str], str]]] = {}
for _role, _own in ROLES.items():
    for _phrase in _own:
        _cut = [p for _, p in _pieces(_phrase)]
        _PHRASES.setdefault(_cut[-1], []).append((_cut, _role))


def _role_of(context: str) -> str:
    """The role of the phrase that ends last in front of a date; of those that end at one place the longest."""
    pieces = _pieces(context)
    for k in range(len(pieces) - 1, -1, -1):
        end = pieces[k][0] + len(pieces[k][1])
        if len(context) - end > LABEL_GAP:
            return ""
        fits = [(len(cut), role) for cut, role in _PHRASES.get(pieces[k][1], ()) if k + 1 >= len(cut) and [p for _, p in pieces[k + 1 - len(cut) : k + 1]] == cut]
        if fits:
            return max(fits)[1]
    return ""


def _day(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day) if year in YEARS else None
    except ValueError:
        return None


def near_year(month: int, day: int, today: dt.date, side: int) -> dt.date | None:
    """The date of last, this or next year that fits: the soonest that isn't over ten days ago (``side`` 1), the latest that isn't over 45 days ahead (-1), or the nearest (0)."""
    days = {(d - today).days: d for y in (-1, 0, 1) if (d := _day(today.year + y, month, day))}
    usual = [off for off in days if side == 0 or (off >= -10 if side > 0 else off <= 45)]
    near = (lambda off: off) if side > 0 and usual else (lambda off: -off) if side < 0 and usual else abs
    return days[min(usual or days, key=near)] if days else None


class _DateReader:
    """Reads dates from the pieces of a folded text; each method starts at a piece and gives (pieces taken, year or none, month, day) or nothing."""

    def __init__(self, pieces: list[tuple[int, str]], month_first: bool):
        self.text, self.month_first = [p for _, p in pieces], month_first

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def number(self, i: int, *sizes: int) -> bool:
        piece = self.at(i)
        return piece.isdecimal() and piece.isascii() and len(piece) in sizes

    def skip(self, i: int, words) -> int:
        """Past one of the words and the blank that must follow it."""
        return i + 2 if self.at(i) in words and self.at(i + 1) == " " else i

    def year(self, i: int, words) -> tuple[int, int | None]:
        j = i + (self.at(i) == ",")
        j = self.skip(j + (self.at(j) == " "), words)
        return (j + 1, int(self.at(j))) if self.number(j, 4) else (i, None)

    def figures(self, i: int):
        mark = self.at(i + 1)
        if mark == "" or mark not in "-/." or self.at(i + 3) != mark or (self.at(i - 1) or " ") in "/.-" or not self.number(i + 2, 1, 2):
            return None
        a, b, c = self.at(i), self.at(i + 2), self.at(i + 4)
        if self.number(i, 4) and a[:2] in ("19", "20") and self.number(i + 4, 1, 2):
            return i + 5, int(a), int(b), int(c)
        goes_on = self.at(i + 5) != "" and self.at(i + 5) in "./-" and self.at(i + 6)[:1].isdecimal()
        if not self.number(i, 1, 2) or not self.number(i + 4, 2, 4) or goes_on:
            return None
        day, month = (int(b), int(a)) if self.month_first else (int(a), int(b))
        if day <= 12 < month:
            day, month = month, day
        return i + 5, int(c) + (2000 if len(c) == 2 else 0), month, day

    def day_and_name(self, i: int):
        if not self.number(i, 1, 2):
            return None
        j = i + 1 + (self.at(i + 1) in ORDINALS)
        j += self.at(j) == "."
        j = self.skip(j + (self.at(j) == " "), OF)
        if self.at(j) not in _MONTH:
            return None
        end, year = self.year(j + 1 + (self.at(j + 1) == "."), OF_YEAR)
        return end, year, _MONTH[self.at(j)], int(self.at(i))

    def name_and_day(self, i: int):
        j = i + 1 + (self.at(i + 1) == ".")
        if self.at(i) not in _MONTH or self.at(i - 1)[-1:].isdecimal() or self.at(j) != " " or not self.number(j + 1, 1, 2):
            return None
        k = j + 2 + (self.at(j + 2) in ORDINALS[:4])
        if self.at(k)[:1].isalnum():
            return None
        end, year = self.year(k, [])
        return end, year, _MONTH[self.at(i)], int(self.at(j + 1))


def find_dates(text: str, today: dt.date, month_first: bool = False) -> list[tuple[int, int, dt.date, str]]:
    """``(from, to, date, role)`` of the dates of the years 1900 to 2100 in a text, in order. A date without a year gets the one that its role asks for; impossible ones are left out."""
    folded = text.translate(_FOLD).lower()
    pieces = _pieces(folded)
    reader, starts = _DateReader(pieces, month_first), [a for a, _ in pieces] + [len(folded)]
    out, end, i = [], 0, 0
    while i < len(pieces):
        first = pieces[i][1]
        forms = (reader.figures, reader.day_and_name) if first.isdecimal() else (reader.name_and_day,) if first in _MONTH else ()
        read = [r for form in forms if (r := form(i)) and (_day(*r[1:]) if r[1] is not None else 1 <= r[3] <= 31)]
        if not read:
            i += 1
            continue
        after, year, month, day = max(read, key=lambda r: r[0])
        a, b = starts[i], starts[after]
        role = _role_of(folded[max(folded.rfind("\n", 0, a) + 1, a - LABEL_WINDOW, end) : a])
        date = _day(year, month, day) if year is not None else near_year(month, day, today, SIDES[role])
        if date:
            out.append((a, b, date, role))
        end, i = b, after
    return out


#: Words before a price that say what it is.
PRICE_LABELS = [
    "importe total a pagar", "total a pagar", "importe a pagar", "importe a cargar", "importe total", "total factura",
    "total pedido", "precio total", "precio final", "amount due", "total due", "total amount", "subtotal", "total",
    "importe", "precio", "price", "amount", "cuota", "pvp", "prima", "iva", "vat", "tax", "envio", "shipping",
    "descuento", "discount", "cargo", "pagado", "paid",
]
#: Blanks and marks between groups of three digits, and signs.
GROUP_MARKS, SIGNS, THIN = " \u00a0\u202f.,'", "-−", " \u00a0"
_MARK = re.compile(MARKS.replace("(?u)", ""))


def read_number(text: str, point: bool) -> Decimal | None:
    """A number written with either decimal mark. Of two marks the last is decimal. One mark before three digits groups them, unless it's a point and ``point`` says that points are decimal; before other digits it's decimal."""
    bare = "".join(c for c in text if c in ".," or c.isdecimal())
    marks = [c for c in bare if c in ".,"]
    groups = bare.replace(",", ".").split(".")
    grouped = len(marks) == 1 and len(groups[1]) == 3 and 0 < len(groups[0]) <= 3 and groups[0][0] != "0" and not (point and marks[0] == ".")
    last = len(set(marks)) == 2 or len(marks) == 1 and not grouped
    whole, decimal = (groups[:-1], groups[-1]) if last else (groups, "")
    if len(set(marks)) == 2 and len(set(marks[:-1])) != 1 or len(whole) > 1 and (len(whole[0]) > 3 or any(len(g) != 3 for g in whole[1:])):
        return None
    return Decimal(f"{''.join(whole) or 0}.{decimal or 0}")


def _number_end(pieces: list[tuple[int, str]], i: int) -> int:
    """The place behind a number that begins at a piece: groups of three digits while there are any, then at most two decimals."""
    at = lambda k: pieces[k][1] if k < len(pieces) else ""
    j = i + 1
    if len(at(i)) <= 3:
        while at(j) and at(j) in GROUP_MARKS and at(j + 1).isdecimal() and len(at(j + 1)) == 3:
            j += 2
    if at(j) in (".", ",") and at(j + 1).isdecimal() and len(at(j + 1)) <= 2:
        j += 2
    return pieces[j - 1][0] + len(pieces[j - 1][1])


def find_prices(text: str, lang: str = "es") -> list[tuple[int, int, int, str, str]]:
    """``(from, to, cents, currency, label)`` of the numbers with a currency before or after them, in order; ``label`` is the word for it in front of them on their line, or empty."""
    pieces = [(m.start(), m[0]) for m in re.finditer(r"[0-9]+|[^0-9]", text)]
    before = {m.end(): m for m in _MARK.finditer(text)}
    there = lambda k, of: 0 <= k < len(text) and text[k] in of

    def signed(a: int) -> int | None:
        """The place of a sign in front of ``a``, with a blank between or not."""
        k = a - 1 - there(a - 1, " ")
        return k if there(k, SIGNS) and not (k and text[k - 1].isascii() and text[k - 1].isalnum()) else None

    found = []
    for i, (a, piece) in enumerate(pieces):
        if not piece.isdecimal() or there(a - 1, ".,"):
            continue
        b = _number_end(pieces, i)
        if mark := _MARK.match(text, b + there(b, THIN)) or _MARK.match(text, b):
            if not (mark.end() < len(text) and text[mark.end()].isdecimal()):
                k = signed(a)
                found.append((a if k is None else k, mark.end(), text[a:b], mark[1], k is not None))
        inner = there(a - 1, SIGNS)
        mark = before.get(a - inner) or before.get(a - inner - there(a - inner - 1, THIN))
        if mark:
            k = signed(mark.start())
            found.append((mark.start() if k is None else k, b, text[a:b], mark[1], k is not None or inner))
    out, end = [], 0
    for a, b, number, written, below in sorted(found):
        code = CODES[written.lower()]
        value = read_number(number, code in POINT_CURRENCIES)
        if a < end or value is None:
            continue
        cents = int((value * 100).quantize(Decimal(1), ROUND_HALF_UP))
        line = text[max(text.rfind("\n", 0, a) + 1, a - 60) : a].translate(_FOLD).lower()
        words = line.rstrip("".join(set(c for c in line if not (c.isascii() and c.isalnum()))))
        label = max((x for x in PRICE_LABELS if words.endswith(x) and len(line) - len(words) <= 12), key=len, default="")
        out.append((a, b, -cents if below else cents, code, label))
        end = b
    return out


def _mentions(docs: DataFrame, doc_id: str, text: str, find, fields: list[T.StructField]) -> DataFrame:
    """A row ``doc`` and the fields of ``find`` for each thing found in each whole text."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column("body").to_pylist()):
                got = find(body or "")
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc")[i].as_py()] * len(got), batch.schema.field("doc").type), *[pa.array(c) for c in zip(*got, strict=True)]], names=["doc", *[f.name for f in fields]])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *fields]))


def date_mentions(docs: DataFrame, doc_id: str, text: str, today: dt.date, month_first: bool = False) -> DataFrame:
    """``doc, role, n, first, last`` of the dates in each text (:func:`find_dates`); the role of those without a label is ``other``."""
    rows = _mentions(docs, doc_id, text, lambda body: [(date, role or "other") for _, _, date, role in find_dates(body, today, month_first)], [T.StructField("date", T.DateType()), T.StructField("role", T.StringType())])
    return rows.groupBy("doc", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def price_totals(docs: DataFrame, doc_id: str, text: str, lang: str = "es") -> DataFrame:
    """``doc, currency, n, low, high, total`` in cents of the prices in each text (:func:`find_prices`), and ``labelled``: the sum of those that a label calls a total, subtotals aside."""
    rows = _mentions(docs, doc_id, text, lambda body: [(cents, code, label) for _, _, cents, code, label in find_prices(body, lang)], [T.StructField("c", T.LongType()), T.StructField("currency", T.StringType()), T.StructField("label", T.StringType())])
    labelled = F.sum(F.when(F.col("label").contains("total") & (F.col("label") != "subtotal"), F.col("c")))
    return rows.groupBy("doc", "currency").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.sum("c").alias("total"), F.coalesce(labelled, F.lit(0)).alias("labelled"))
