"""Rules of reading values, each on the examples that tell right from nearly right."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orewright.operators import amounts, entities, extract, mentions, network, shapes, text


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, v {kind}")
    return [r["x"] for r in rows.select("id", column(F.col("v")).alias("x")).orderBy("id").collect()]


def test_amounts(spark):
    rows = [("a", "(12,00)"), ("a", "−5,50"), ("a", "12,50-"), ("a", "1.234,5 €"), ("a", "+3"), ("a", "12 apples"), ("a", None), ("a", ""), ("b", "$1.234"), ("b", "1.234 EUR"), ("b", "1.234.567"), ("b", "2,099"), ("b", "0.123"), ("b", "-(5)"), ("c", "1,234.56"), ("c", "1 299"), ("c", "1.2.3"), (None, "7,25 zł"), ("b", "1.2345.678")]
    got = amounts.parse_amounts(spark.createDataFrame(rows, "g string, v string"), "v", "g").collect()
    found = {(r["g"], r["v"]): r["cents"] for r in got}
    assert len(got) == len(rows) and found == {
        ("a", "(12,00)"): -1200, ("a", "−5,50"): -550, ("a", "12,50-"): -1250, ("a", "1.234,5 €"): 123450, ("a", "+3"): 300, ("a", "12 apples"): None, ("a", None): None, ("a", ""): None, ("b", "$1.234"): 123, ("b", "1.234 EUR"): 123400,
        ("b", "1.234.567"): 123456700, ("b", "2,099"): 209900, ("b", "0.123"): 12, ("b", "-(5)"): None, ("c", "1,234.56"): 123456, ("c", "1 299"): 129900, ("c", "1.2.3"): None, (None, "7,25 zł"): 725, ("b", "1.2345.678"): None,
    }


def test_steady_texts(spark):
    def digest(t):
        return one(spark, [t], lambda c: F.expr(text.steady_sql("v")))[0]

    assert digest("Price 10 EUR") != digest("Price 99 EUR") and digest("Привет") != digest("你好") and digest("Привет") == "привет"
    assert digest("  A\tB \r\nUpdated 3 mins ago\n© 2024 me\nHoy es lunes\nat 10:30 pm, hace 5 minutos") == "a b\nat , "[:-1]
    assert digest("2024-01-02T10:11:12Z x 0123456789abcdef0 y") == "x y" and digest("seen 3 days left, just now") == "seen ," and digest("Ｆｕｌｌ　width") == "full width"
    assert digest("copyrighted") == "copyrighted" and digest("Copyright me") == "" and digest("in 3 hoursx") == "in 3 hoursx"


def test_page_quality(spark):
    menu = "Home\nYour Cart\nHelp\n" + "one two three four five six\n"
    values = ["lines of four words\n" * 200, "two words\n" * 100, "two words\n" * 300, "Please enable JavaScript now", "word " * 39, "word " * 40, menu * 2, None, "Shipping and Returns\n" * 20]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")
    got = {r["id"]: r["quality"] for r in text.page_quality(rows).collect()}
    assert got == {0: "ok", 1: "mostly navigation", 2: "ok", 3: "blocked page", 4: "too short", 5: "ok", 6: "too short", 7: "too short", 8: "mostly navigation"}
    pages = spark.createDataFrame([("http://a.example.org/x", "word " * 50), ("https://b.example.org/y", None)], "url string, text string")
    assert {tuple(r) for r in text.quality_census(pages, "url", "text").collect()} == {("example.org", "ok", 1), ("example.org", "too short", 1)}


def test_buildings(spark):
    tags = [{"building:levels": "4", "roof:levels": "1"}, {"height": "10,5 m"}, {"height": "30 ft", "roof:shape": "spire"}, {"height": "12'"}, {"building": "church"}, {}, {"height": "0", "building:levels": "2"}, {"height": "3", "min_height": "9"}, {"height": "5d"}, {"roof:shape": "half_hipped", "height": "2000"}, {"roof:shape": "crosspitched", "building:min_level": "1", "height": "20 metres"}]
    got = [tuple(r)[1:] for r in entities.building_attributes(spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "id long, tags map<string,string>")).orderBy("id").collect()]
    assert [g[0] for g in got] == [14.95, 10.5, 9.144, 3.6576, 18.0, 7.0, 7.2, 3.0, 7.0, 900.0, 20.0]
    assert [g[2] for g in got] == [False] * 4 + [True] * 2 + [False] * 2 + [True] + [False] * 2
    assert got[7][1] == 2.0 and got[10][1] == 3.1 and [got[k][3] for k in (0, 2, 9, 10)] == ["", "cone", "half-hipped", "gabled"] and got[0][4] == 3.1


def test_open_bodies_have_no_volume(spark):
    faces = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "model_id long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    body = shapes.mesh_bodies(faces).first()
    assert (body["closed"], body["volume"], body["inverted"], body["triangles"]) == (False, None, False, 1) and (body["x1"], body["cy"]) == (1.0, 0.3333)
    loop = shapes.list_open_loops(faces).first()
    assert (loop["loop"], loop["edges"], loop["length"], loop["z1"]) == (1, 3, 4.1463, 1.0)


def test_captions_go_on_after_a_blank_only(spark):
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, "hello"), (1, 2, 1.0, 2.0, "helloworld"), (1, 3, 2.0, 3.0, "helloworld again")], "file long, n long, start double, end double, text string")
    assert [r["text"] for r in extract.dedupe_rolling(cues).orderBy("n").collect()] == ["hello", "helloworld again"]


def test_identifiers_in_all_spellings(spark):
    assert one(spark, ["12345678Z", "12.345.678-Z", "12345678z", "1234567L", "12345678A", "123456Z", None], entities.valid_dni) == [True, True, True, True, False, False, None]
    ibans = ["ES91 2100 0418 4502 0005 1332", "es9121000418450200051332", "ES91210004184502000513", "GB29 NWBK 6016 1331 9268 19", "XX", "DE89370400440532013000"]
    assert one(spark, ibans, entities.valid_iban) == [True, True, False, True, False, True]
    assert one(spark, ["40 06381-333931", "4006381333932", "96385074"], entities.valid_ean) == [True, False, True]


def test_a_share_out_of_reach_is_refused(spark):
    reach = spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.0), (2, 11, 1.0)], "site long, demand long, cost double")
    weights = spark.createDataFrame([(10, 3.0), (11, 2.0), (12, 95.0)], "demand long, weight double")
    costs = spark.createDataFrame([(1, 0.0), (2, 1.0)], "site long, cost double")
    with pytest.raises(ValueError, match="5.000 %"):
        network.min_sites(reach, weights, costs, 0.9)
    assert [tuple(r) for r in network.min_sites(reach, weights, costs, 0.05).collect()] == [(1, 1, 3.0, 3.0), (2, 2, 2.0, 5.0)]


def test_dates_of_likely_years():
    today = dt.date(2024, 6, 1)
    found = mentions.find_dates("fecha de emisión: 03/04/3026, 5 mayo 99, vence el 15 de octubre; se renovará el 1 oct. 2025. Valid until Oct 3rd, 2030, 12.11.1999", today)
    assert [(d.isoformat(), role) for _, _, d, role in found] == [("2024-05-05", "issued"), ("2024-10-15", "due"), ("2025-10-01", "renewal"), ("2030-10-03", "expires"), ("1999-11-12", "")]


def test_personal_data_after_words_and_cut_to_its_country():
    kinds = lambda t: [(t[a:b], k) for a, b, k in extract.scan_pii(t)]
    assert kinds("Teléfono: 600123456, tel. 91 234 56 78; fax 600123456") == [("600123456", "phone"), ("91 234 56 78", "phone")]
    assert kinds("ES91 2100 0418 4502 0005 1332 AND more") == [("ES91 2100 0418 4502 0005 1332", "iban")]
    assert kinds("x@y.org. a.b+c@d-e.co.uk, @no, n@o.1") == [("x@y.org", "email"), ("a.b+c@d-e.co.uk", "email")]


def test_ranks_of_minus_k_dont_end_the_fusion(spark):
    """a rank of -60 made the divisor 0, which ended the query."""
    hits = spark.createDataFrame([("x", -60, "https://a.org/1"), ("y", 2, "https://a.org/1"), ("x", 1, "https://a.org/2")], "engine string, rank long, url string")
    assert {r["key"]: r["score"] for r in text.rrf_urls(hits).collect()} == {"a.org/1": float("inf"), "a.org/2": 1 / 61}
    lists = spark.createDataFrame([("l", 1, -60, 0.5), ("l", 2, 0, 0.5), ("l", 3, None, 0.5)], "list string, id long, rank long, weight double")
    assert {r["id"]: r["score"] for r in text.rrf(lists).collect()} == {1: float("inf"), 2: 0.5 / 60, 3: None}
