"""Planted numbers of parcels and products, right and wrong by one digit."""

from pyspark.sql import functions as F

from orewright.operators import references


def test_parcels_of_each_carrier(spark):
    numbers = {
        "1Z999AA10123456784": ("ups", 98), "1Z999AA10123456785": ("ups", 70), "RR123456785CN": ("chinapost", 92), "rr 123456785-es": ("correos", 92), "RR123456785JP": ("other", 92), "RR123456784CN": ("", 0),
        "JJD000390007882217771": ("dhl", 88), "JVGL12345678": ("dhl", 88), "3SABCD123456": ("postnl", 85), "YT2012345678901234": ("yunexpress", 92), "LP00123456789012": ("cainiao", 75), "TBA123456789": ("amazon", 85),
        "PQ4F6P0712345678901": ("correos", 72), "PABCDEFGHIJKLMNOPQ": ("", 0), "600123456": ("", 0), "": ("", 0), None: (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in numbers], "n string")
    got = {r["n"]: (r["c"]["carrier"], r["c"]["confidence"]) for r in rows.select("n", references.classify_parcel(F.col("n")).alias("c")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in numbers.items() if k is not None}


def test_references_in_texts(spark):
    text = "Sent 1Z999AA10123456784, again 1Z999AA10123456784 and RR123456785CN; ISBN-10: 0-306-40615-2, ean 4006381333931 4006381333932 9780306406157 https://a.com/dp/b00example x B0ABCDEFGH ?sku=ab-12345&id=words /p/B0ABCDEFGH"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    assert {tuple(r) for r in references.tracking_numbers(docs, "id", "t").collect()} == {(1, "1Z999AA10123456784", "ups", 98), (1, "RR123456785CN", "chinapost", 92)}
    assert {tuple(r)[1:] for r in references.product_ids(docs, "id", "t").collect()} == {("ean", "4006381333931"), ("ean", "9780306406157"), ("isbn", "9780306406157"), ("isbn", "0306406152"), ("asin", "B00EXAMPLE"), ("asin", "B0ABCDEFGH"), ("sku", "AB-12345")}
    assert {tuple(r) for r in references.reference_kinds(docs, "id", "t").collect()} >= {("parcel", "ups", 1, 1), ("ean", "", 2, 1)}
