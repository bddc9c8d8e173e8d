import pytest
from pyspark.sql import functions as F

from orewright.operators import entities, extract


@pytest.mark.parametrize("overlap", [0, 60])
def test_chunks_cover_the_text(overlap):
    text = "\n\n".join(" ".join(f"word{i * j % 97}," if j % 7 else f"end{j}." for j in range(80)) for i in range(30)) + "x" * 900
    spans = list(extract.cut_points(text, 400, overlap))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 480 for a, b in spans) and all(a2 <= b1 and a2 > a1 for (a1, b1), (a2, _) in zip(spans, spans[1:]))
    if not overlap:
        assert "".join(text[a:b] for a, b in spans) == text
    assert not list(extract.cut_points("", 400, overlap))


def test_readable_page():
    title, text = extract.readable("<html><head><title> A &amp; B </title><script>x()</script></head><body><nav>menu</nav><article><h1>Head</h1><p>One<br>two</p></article><footer>f</footer></body>")
    assert title == "A & B" and text == "Head\nOne\ntwo"
    assert extract.readable("") == ("", "") and extract.readable("<p>plain")[1] == "plain"


def test_masks_and_census(spark):
    texts = [(1, "mail a@b.org, 12345678Z and 12345678A", ["x@y.org", None]), (2, None, None), (3, "ip 10.0.0.7 or 300.1.1.1; card 4111 1111 1111 1111, not 4111111111111112", []), (4, "IBAN ES91 2100 0418 4502 0005 1332 AND X-1234567-L, B12345674, call +34 600 123 456", ["600 12 34 56"])]
    rows = spark.createDataFrame(texts, "id long, text string, more array<string>")
    nested = rows.select("id", "text", "more", F.struct(F.col("text").alias("t"), F.lit(5).alias("n")).alias("s"), F.create_map(F.lit("k"), F.col("text")).alias("m"), F.array(F.struct(F.col("text").alias("t"))).alias("l"))
    got = {r["id"]: r for r in extract.mask_columns(nested, ("email", "ip", "dni", "card", "iban", "nie")).collect()}
    assert got[1]["text"] == "mail <email>, <dni> and 12345678A" and got[1]["more"] == ["<email>", None] and got[2]["text"] is None and got[2]["more"] is None
    assert got[3]["text"] == "ip <ip> or 300.1.1.1; card <card>, not 4111111111111112"
    for r in got.values():
        assert r["s"]["t"] == r["m"]["k"] == r["l"][0]["t"] == r["text"] and r["s"]["n"] == 5
    assert got[4]["text"].startswith("IBAN <iban> AND <nie>,")
    census = {r["kind"]: r["n"] for r in extract.pii_census(rows.withColumn("s", F.lit("s")), "text", "s").collect()}
    assert census == {"email": 1, "dni": 1, "ip": 1, "card": 1, "iban": 1, "nie": 1, "cif": 1, "phone": 1}


def test_rolling_captions(spark):
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, "hello"), (1, 2, 1.0, 2.0, "hello there"), (1, 3, 2.0, 3.0, "hello  there"), (1, 4, 3.0, 4.0, "bye"), (1, 5, 4.0, 5.0, None)], "file long, n long, start double, end double, text string")
    assert [(r["text"], r["end"]) for r in extract.dedupe_rolling(cues).orderBy("n").collect()] == [("hello there", 3.0), ("bye", 4.0)]


def test_markdown_sections(spark):
    body = "---\nt: x\n---\nintro\n# A\none\n\ntwo\n## B\n```\n# not a heading\n```\n# C\nlast"
    rows = extract.chunk_markdown(spark.createDataFrame([(1, body), (2, None)], "id long, body string"), "id", "body").orderBy("n").collect()
    assert [(r["path"], r["chunk"]) for r in rows] == [("", "intro"), ("A", "one\n\ntwo"), ("A § B", "```\n# not a heading\n```"), ("C", "last")]


def test_identifiers(spark):
    rows = spark.createDataFrame([("4006381333931", True), ("4006381333932", False), (None, None)], "c string, ok boolean")
    assert all(r["v"] == r["ok"] for r in rows.withColumn("v", entities.valid_ean13(F.col("c"))).collect())
    ibans = spark.createDataFrame([("ES9121000418450200051332", True), ("ES9121000418450200051333", False)], "c string, ok boolean")
    assert all(r["v"] == r["ok"] for r in ibans.withColumn("v", entities.valid_iban(F.col("c"))).collect())
    mails = spark.createDataFrame([("Ann <A.B+x@Googlemail.com>", "ab@gmail.com"), ("mailto:q@x.org", "q@x.org"), ("nobody", "")], "c string, k string")
    assert all(r["v"] == r["k"] for r in mails.withColumn("v", entities.email_key(F.col("c"))).collect())


def test_small_groups_settle_with_the_fewest_transfers(spark):
    from itertools import combinations

    from orewright.operators import ledger

    groups = {1: [5, -5, 7, -7, 3, -2, -1], 2: [10, -4, -6, 4, -4], 3: [100, -50, -30, -20], 4: [0, 0], 5: list(range(1, 13)) + [-78]}

    def most(values):  # balanced parts, by trying all first parts
        values = [v for v in values if v]
        if not values:
            return 0
        first, rest = values[0], values[1:]
        ways = [1 + most([v for i, v in enumerate(rest) if i not in c]) for n in range(len(rest) + 1) for c in combinations(range(len(rest)), n) if first + sum(rest[i] for i in c) == 0]
        return max(ways, default=0)

    rows = [(g, k, v) for g, values in groups.items() for k, v in enumerate(values)]
    got = ledger.settle_groups(spark.createDataFrame(rows, "grp long, member long, net long")).collect()
    for g, values in groups.items():
        own = [r for r in got if r["grp"] == g]
        left = dict(enumerate(values))
        for r in own:
            left[r["debtor"]] += r["cents"]
            left[r["creditor"]] -= r["cents"]
        assert not any(left.values()) and all(r["cents"] > 0 for r in own)
        assert len(own) == sum(1 for v in values if v) - most(values)
