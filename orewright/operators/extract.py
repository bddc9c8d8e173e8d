"""Jobs over long texts and pages whose rules need a loop: chunks, snippets, readable text, personal data. Each runs on Arrow batches, document by document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.operators.entities import DNI_LETTERS, IBAN_LENGTHS

_BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?…])\s"), re.compile(r"(?<=[,;:])\s"), re.compile(r"\s"))


def cut_points(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(from, to) of chunks of at most ``size`` characters: each ends at its last break of the best kind (paragraph, line, sentence, clause, word) that isn't in its first two fifths, and the next starts ``overlap`` before, at a word. A tail shorter than a fifth joins the chunk before it."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if n - end <= size // 5:
            yield start, n
            return
        for kind in _BREAKS:
            ends = [m.end() for m in kind.finditer(text, start + 2 * size // 5, end)]
            if ends:
                end = ends[-1]
                break
        yield start, end
        back = max(end - overlap, start + 1)
        word = re.compile(r"(?<=\s)\S").search(text, back, end) if overlap else None
        start = word.start() if word else end


def chunk_corpus(docs: DataFrame, doc_id: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``doc, n, start, end, chunk`` of each whole text; a null or empty text has none."""
    def run(batches):
        for batch in batches:
            for doc, body in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), strict=True):
                spans = list(cut_points(body or "", size, overlap))
                if spans:
                    yield pa.RecordBatch.from_pydict({"doc": pa.array([doc] * len(spans), pa.int64()), "n": pa.array(range(len(spans)), pa.int64()), "start": pa.array([a for a, _ in spans], pa.int64()), "end": pa.array([b for _, b in spans], pa.int64()), "chunk": pa.array([body[a:b] for a, b in spans], pa.string())})

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body")).mapInArrow(run, "doc long, n long, start long, end long, chunk string")


def snippet(text: Column, term: Column, window: int = 120) -> Column:
    """The text around the first word that starts with the term, whole words only, that word between ``[`` and ``]``; the text's start where there is none."""
    at = F.regexp_instr(F.lower(text), F.concat(F.lit(r"\b"), F.regexp_replace(F.lower(term), r"([^\p{L}\p{N}])", r"\\$1")))
    begin = F.greatest(at - window // 2, F.lit(1))
    part = F.substring(text, begin, F.lit(window))
    left = F.when(begin > 1, F.concat(F.lit("…"), F.regexp_replace(part, r"^\S*\s", ""))).otherwise(part)
    whole = F.when(begin + window <= F.length(text), F.concat(F.regexp_replace(left, r"\s\S*$", ""), F.lit("…"))).otherwise(left)
    marked = F.regexp_replace(whole, F.concat(F.lit(r"(?i)\b("), F.regexp_replace(term, r"([^\p{L}\p{N}])", r"\\$1"), F.lit(r"[\p{L}\p{N}]*)")), F.lit("[$1]"))
    return F.when(at == 0, F.substring(text, 1, window)).otherwise(marked)


def snippets(hits: DataFrame, docs: DataFrame, window: int = 120) -> DataFrame:
    """``doc, term, snippet`` of hits (``doc, term``) in documents (``doc, text``)."""
    return hits.join(docs, "doc").select("doc", "term", snippet(F.col("text"), F.col("term"), window).alias("snippet"))


class _Readable(HTMLParser):
    """Title and text outside navigation, scripts and other chrome; that of ``article`` or ``main`` where there's one."""

    SKIP = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "template", "svg"}
    BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.all, self.main = [], [], []
        self.skip = self.inside = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.inside += tag in ("article", "main")
        self.in_title |= tag == "title"
        if tag in self.BLOCK:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag in self.BLOCK:
            self.handle_data("\n")
        self.inside -= tag in ("article", "main") and self.inside > 0
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.all.append(data)
            if self.inside:
                self.main.append(data)


def readable(html: str) -> tuple[str, str]:
    page = _Readable()
    page.feed(html)
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.main if "".join(page.main).strip() else page.all).split("\n"))
    return " ".join("".join(page.title).split()), "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, title, text``: what a reader sees of each page. Null pages are empty."""
    def run(batches):
        for batch in batches:
            got = [readable(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "title": pa.array([t for t, _ in got], pa.string()), "text": pa.array([t for _, t in got], pa.string())})

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, title string, text string")


#: Kinds of personal data, and how their numbers are written. ``d`` is a digit, ``L`` a letter, ``U`` one of the kinds of companies, ``C`` a digit or one
#: of A to J, ``X`` one of X, Y and Z, ``p`` the first digit of a telephone; ``?`` makes the next sign optional; ``~`` is a blank, a point, a hyphen or nothing and ``_`` one of these.
KINDS = ("iban", "dni", "nie", "cif", "card", "email", "phone", "ip")
SHAPES = {
    "dni": ["dd?.ddd?.ddd?-L"],
    "nie": ["X?-ddddddd?-L"],
    "cif": ["U?-ddddddd?-C"],
    "phone": ["+34~pdd~ddd~ddd", "0034~pdd~ddd~ddd", "pdd_ddd_ddd", "pdd_dd_dd_dd"],
}
SIGNS = {"d": "0123456789", "U": "ABCDEFGHJNPQRSUVW", "C": "0123456789ABCDEFGHIJ", "X": "XYZxyz", "p": "6789", "_": " .-"}
#: Words before a telephone.
PHONE_WORDS = ["teléfono", "telefono", "tel", "tfno", "móvil", "movil", "phone", "mobile", "contacto", "whatsapp"]
_PHONE_WORD = re.compile("|".join(sorted(PHONE_WORDS, key=len, reverse=True)), re.I)


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _fit(text: str, at: int, shape: str) -> int:
    """The place behind what is written in a shape at a place; 0 where it isn't."""
    signs = iter(shape)
    for sign in signs:
        optional = sign in "?~"
        sign = next(signs) if sign == "?" else "_" if sign == "~" else sign
        c = text[at : at + 1]
        if c and (c in SIGNS.get(sign, sign) if sign != "L" else c.isascii() and c.isalpha()):
            at += 1
        elif not optional:
            return 0
    return at


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _letter(number: int, letter: str) -> bool:
    return DNI_LETTERS[number % 23] == letter.upper()


def _company(value: str) -> bool:
    digit = -sum(d if i % 2 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(map(int, value[1:8]))) % 10
    by_letter, by_digit = value[8] == "JABCDEFGHI"[digit], value[8] == str(digit)
    return by_letter if value[0] in "NPQRSW" else by_digit if value[0] in "ABEH" else by_letter or by_digit


#: What numbers of a kind must pass, without marks.
CHECKS = {"dni": lambda v: _letter(int(v[:8]), v[8]), "nie": lambda v: _letter(int(str("XYZ".index(v[0].upper())) + v[1:8]), v[8]), "cif": _company}


def _grouped(text: str, at: int, marks: str, signs, most: int) -> list[tuple[int, int]]:
    """Ends of groups that begin at a place, and how many signs (``signs(c)``) there are up to each; single ``marks`` part groups."""
    ends, n = [], 0
    while at < len(text) and n < most and signs(text[at]):
        while at < len(text) and n < most and signs(text[at]):
            at, n = at + 1, n + 1
        if at == len(text) or not _alnum(text[at]):
            ends.append((at, n))
        at += at < len(text) and text[at] in marks
    return ends


def _card(text: str, at: int) -> tuple[int, bool]:
    """The place behind the longest run of 13 to 19 digits, and whether its check digit is right."""
    ends = [e for e, n in _grouped(text, at, " -", str.isdecimal, 19) if n >= 13]
    return (ends[-1], _luhn("".join(c for c in text[at : ends[-1]] if c.isdecimal()))) if ends else (0, False)


def _iban(text: str, at: int) -> tuple[int, bool]:
    """The place behind an account in fours after its country and check digits, cut to what its country has, and whether its remainder is right."""
    if not (text[at : at + 2].isascii() and text[at : at + 2].isupper() and text[at : at + 2].isalpha() and text[at + 2 : at + 4].isdecimal() and len(text[at : at + 4]) == 4):
        return 0, False
    upper = lambda c: c.isascii() and (c.isdecimal() or c.isupper())
    end, n, last = at, 0, 0
    while end < len(text) and n < 36 and (upper(text[end]) or n % 4 == 0 and n and text[end] in " -" and upper(text[end + 1 : end + 2] or " ")):
        n += upper(text[end])
        end += 1
        if n >= 16 and upper(text[end - 1]) and not _alnum(text[end : end + 1]):
            last = end
    if not last:
        return 0, False
    due = IBAN_LENGTHS.get(text[at : at + 2])
    places = [k for k in range(at, last) if text[k] not in " -"]
    stop = places[due - 1] + 1 if due and len(places) > due else last
    bare = "".join(c for c in text[at:stop] if c not in " -")
    right = len(bare) == due if due else 15 <= len(bare) <= 34
    return last, right and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and stop


def _numbers(text: str, kinds: tuple[str, ...]) -> Iterator[tuple[int, int, str]]:
    """Numbers of all kinds but telephones after a word: each run of digits is looked at with what may stand right in front of it."""
    passed = {"card": 0, "iban": 0}
    for run in re.finditer("[0-9]+", text):
        a = run.start()
        for back in range(4):
            at = a - back
            if at < 0 or back and text[at].isdecimal():
                break
            before = text[at - 1] if at else " "
            if _alnum(before):
                continue
            if back == 0 and "card" in kinds and at >= passed["card"]:
                end, right = _card(text, at)
                passed["card"] = max(end, passed["card"])
                if right:
                    yield at, end, "card"
            if back == 2 and "iban" in kinds and at >= passed["iban"]:
                end, stop = _iban(text, at)
                passed["iban"] = max(end, passed["iban"])
                if stop:
                    yield at, stop, "iban"
            if back == 0 and "ip" in kinds and before != ".":
                parts = re.match(r"([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})(?![0-9]|[.][0-9])", text[at : at + 20])
                if parts and all(int(x) < 256 for x in parts.groups()):
                    yield at, at + parts.end(), "ip"
            for kind, shapes in SHAPES.items():
                if kind not in kinds or kind == "dni" and before == ".":
                    continue
                for shape in shapes:
                    end = _fit(text, at, shape)
                    after = text[end : end + 1]
                    if not end or after and (after in SIGNS["d"] or kind != "phone" and _alnum(after)):
                        continue
                    if kind != "phone":
                        if CHECKS[kind]("".join(c for c in text[at:end] if c not in ".-")):
                            yield at, end, kind
                    elif shape[0] != "p":
                        if before != "+":
                            yield at, end, kind
                    elif before not in "+.-" and not _alnum(after or " ") and after != "-" and not (after and after in ".," and text[end + 1 : end + 2].isdecimal()):
                        yield at, end, kind


def _told_phones(text: str) -> Iterator[tuple[int, int, str]]:
    """Telephones after a word for them: nine digits, with their country or without."""
    for word in _PHONE_WORD.finditer(text):
        at = word.end()
        gap = len(text[at : at + 12]) - len(text[at : at + 12].lstrip(" \t\n:."))
        at += gap if text[at : at + gap].count(":") + text[at : at + gap].count(".") <= 1 + (word[0].lower() in ("tel", "tfno")) else 0
        sign = text[at : at + 1] == "+"
        end = at + sign
        while end < len(text) and end - at - sign < 20 and text[end] in "0123456789 .-":
            end += 1
        value = text[at:end].rstrip(" .-")
        digits = "".join(c for c in value if c.isdecimal())
        own = digits[4:] if digits.startswith("0034") else digits[2:] if digits.startswith("34") and len(digits) == 11 else digits
        if text[at + sign : at + sign + 1].isdecimal() and len(value) - sign - 2 * digits.startswith("00") <= 18 and len(own) == 9 and own[0] in SIGNS["p"]:
            yield at, at + len(value), "phone"


def _mails(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses around each ``@``: the longest host with a last part of two letters at least."""
    for k in [m.start() for m in re.finditer("@", text)]:
        a, b = k, k + 1
        while a and (_alnum(text[a - 1]) or text[a - 1] in "._%+-"):
            a -= 1
        while b < len(text) and (_alnum(text[b]) or text[b] in ".-"):
            b += 1
        parts = text[k + 1 : b].split(".")
        while parts and not (len(parts) > 1 and ".".join(parts[:-1]) and len(parts[-1]) > 1 and parts[-1].isalpha()):
            parts.pop()
        if a < k and parts:
            yield a, k + 1 + len(".".join(parts)), "email"


def scan_pii(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """``(from, to, kind)`` of personal data that passes its checks, in order; of what overlaps, the first counts, and of those the longest."""
    found = list(_numbers(text, kinds))
    found += _told_phones(text) if "phone" in kinds else []
    found += _mails(text) if "email" in kinds else []
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda h: (h[0], -h[1], KINDS.index(h[2]))):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def pii_census(docs: DataFrame, text: str, source: str) -> DataFrame:
    """``source, kind, n, docs``: personal data that passes its checks, by source; of what overlaps, one kind counts."""
    kind = docs.select(F.col(source).alias("source")).schema["source"]

    def run(batches):
        for batch in batches:
            rows = [(i, k, n) for i, body in enumerate(batch.column("body").to_pylist()) for k, n in Counter(h[2] for h in scan_pii(body or "")).items()]
            if rows:
                at, kinds, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(at)), pa.array(kinds), pa.array(n, pa.int64())], names=["source", "kind", "k"])

    schema = T.StructType([kind, T.StructField("kind", T.StringType()), T.StructField("k", T.LongType())])
    rows = docs.select(F.col(source).alias("source"), F.col(text).alias("body")).mapInArrow(run, schema)
    return rows.groupBy("source", "kind").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


def mask_string(text: str | None, kinds: tuple[str, ...] = KINDS) -> str | None:
    """The text with the personal data that :func:`scan_pii` finds replaced by ``<kind>``."""
    out, at = [], 0
    for a, b, kind in scan_pii(text or "", kinds):
        out.append(f"{text[at:a]}<{kind}>")
        at = b
    return "".join([*out, text[at:]]) if out else text


def _masked(values: pa.Array, kinds: tuple[str, ...]) -> pa.Array:
    """All strings in an array masked, however deep they lie in lists, structs and values of maps."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array([mask_string(v, kinds) for v in values.to_pylist()], kind)
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(values.offsets, values.keys, _masked(values.items, kinds), kind, mask=values.is_null())
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(values.offsets, _masked(values.values, kinds), kind, mask=values.is_null())
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_masked(values.field(i), kinds) for i in range(kind.num_fields)], fields=list(kind), mask=values.is_null())
    return values


def mask_columns(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All strings masked, those in arrays, structs and values of maps too; data that fails its checks stays."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_masked(c, kinds) for c in batch.columns], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def mask_text(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The text with personal data replaced by ``<kind>``, in Arrow batches, as checks of digits at their places need a loop."""
    return F.pandas_udf(lambda values: values.map(lambda v: mask_string(v, kinds)), T.StringType())(text)


def dedupe_rolling(cues: DataFrame) -> DataFrame:
    """``file, n, text, end`` of cues (``file, n, start, end, text``) that aren't repeated by rolling captions: one equal to one of the last three kept extends it, one that goes on from the last kept after a blank replaces it.

    Order within a file matters, so a file is in one task; its cues stream through it in order, and only the last three kept are held.
    """
    schema = pa.schema([("file", pa.int64()), ("n", pa.int64()), ("text", pa.string()), ("end", pa.float64())])

    def run(batches):
        file, kept, out = None, [], []
        for batch in batches:
            for own, n, end, text in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "end", "text")), strict=True):
                if file != (own,):
                    out, file, kept = out + kept, (own,), []
                text = " ".join((text or "").split())
                same = next((k for k in kept if k[2] == text), None)
                if same:
                    same[3] = max(same[3], end)
                elif kept and text.startswith(kept[-1][2] + " "):
                    kept[-1][2:] = [text, end]
                elif text:
                    kept.append([own, n, text, end])
                    out, kept = out + kept[:-3], kept[-3:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)

    rows = cues.select(F.col("file").cast("long").alias("file"), F.col("n").cast("long").alias("n"), "end", "text").repartition("file").sortWithinPartitions("file", "n")
    return rows.mapInArrow(run, "file long, n long, text string, end double")


def chunk_markdown(docs: DataFrame, doc_id: str, text: str, size: int = 1000) -> DataFrame:
    """``doc, n, path, chunk``: the sections of Markdown texts under their heading path, front matter left out, paragraphs packed up to ``size``; a longer paragraph is a chunk."""
    def sections(body: str) -> Iterator[tuple[str, str]]:
        body = re.sub(r"\A---\n.*?\n---\n", "", body, flags=re.S)
        heads: list[str] = []
        held: list[str] = []
        fenced = False
        for line in [*body.split("\n"), None]:
            head = None if line is None or fenced else re.match(r"(#{1,6})\s+(\S.*)", line)
            if line is None or head:
                if "\n".join(held).strip():
                    yield " § ".join(h for h in heads if h), "\n".join(held).strip()
                held = []
                if head:
                    level = len(head[1])
                    heads = [*heads[: level - 1], *[""] * (level - 1 - len(heads)), head[2].strip()]
            else:
                fenced ^= bool(re.match(r"\s*(```|~~~)", line))
                held.append(line)

    def run(batches):
        for batch in batches:
            for doc, body in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), strict=True):
                out: list[tuple[str, str]] = []
                for path, section in sections(body or ""):
                    packed = ""
                    for p in re.split(r"\n\s*\n", section):
                        if packed and len(packed) + len(p) + 2 > size:
                            out.append((path, packed))
                            packed = ""
                        packed = f"{packed}\n\n{p}" if packed else p
                    out.append((path, packed))
                if out:
                    yield pa.RecordBatch.from_pydict({"doc": pa.array([doc] * len(out), pa.int64()), "n": pa.array(range(len(out)), pa.int64()), "path": [p for p, _ in out], "chunk": [c for _, c in out]})

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body")).mapInArrow(run, "doc long, n long, path string, chunk string")
