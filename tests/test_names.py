"""Names of any number of words, written together, with signs and accents; mentions and what contains them."""

from orewright.operators import entities, names
from orewright.plans.shared import materialize


def matched(spark, items, members, aliases=(), **options):
    df = names.match_names(
        spark.createDataFrame([(i, *x) if isinstance(x, tuple) else (i, x, False) for i, x in enumerate(items)], "id long, name string, is_dir boolean"),
        spark.createDataFrame(list(enumerate(members)), "member long, name string"), spark.createDataFrame(list(aliases), "member long, alias string"), names.MatchOptions(**options),
    )
    return {r["id"]: (r["member"], r["how"], r["candidates"]) for r in df.collect()}


def test_words_of_a_name():
    assert names.split_name("0001_Bulbasaur") == ["bulbasaur"] and names.split_name("12 34") == ["12", "34"] and names.split_name("2 3 x 4") == ["x", "4"]
    assert names.split_name("Nidoran♀ d'Arc v1.2") == ["nidoran", "f", "darc", "v12"] and names.split_name("ＡÉ") == ["ae"] and names.split_name(None) == []
    assert names.split_name("A-b  c", names.MatchOptions(separators=False, case=False)) == ["A-b", "c"]


def test_names_of_any_length_match(spark):
    long = "one two three four five"
    got = matched(spark, [long, f"my {long} final.stl", "Onetwo threefourfive", "Mr Mime", "x mr.mime-jr y", "mr", "", None, ("v1.5 Ivy", True)], [long, "Mr. Mime", "mime jr", "v1", "ivy v15"], [(1, "Barrier"), (4, "v15 ivy")])
    assert got[0][:2] == got[2][:2] == (0, "exact") and got[1][:2] == (0, "span") and got[3][:2] == (1, "exact")
    assert got[4] == (None, "none", None)  # written mrmime jr
    assert got[5][1] == got[6][1] == got[7][1] == "none" and got[8][:2] == (4, "alias")
    got = matched(spark, ["red fox blue owl", "the red fox", "Fuchs", "RED FOX"], ["red fox", "blue owl", "fox"], [(0, "fuchs")])
    assert got == {0: (None, "ambiguous", [0, 1]), 1: (0, "span", None), 2: (0, "alias", None), 3: (0, "exact", None)}
    assert matched(spark, ["the red fox", "RED FOX", "red_fox"], ["red fox"], contains=False, case=False, separators=False) == {0: (None, "none", None), 1: (None, "none", None), 2: (None, "none", None)}


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "The Bank of New York, and the bank", "a"), (2, "a bank of new york mellon; BANK OF NEW YORK", "a"), (3, None, "b"), (4, "Bank! then bank of new york", "b"), (4, "nothing", "c")], "id long, text string, source string")
    words = spark.createDataFrame([(1, "bank of new york"), (2, "bank"), (3, "Bank of New York Mellon"), (3, "new york"), (4, "..."), (4, None)], "entity long, name string")
    found = {(r["doc"], r["entity"], r["at"], r["n"]) for r in names.find_mentions(docs, words, "id").collect()}
    # a first mention within a longer one goes, also where a later one would stand alone
    assert found == {(1, 1, 1, 4), (2, 3, 1, 5), (4, 1, 2, 4), (4, 2, 0, 1)}
    assert {tuple(r) for r in names.mention_counts(docs, words, "id", by=("source",)).collect()} == {(1, "a", 1), (3, "a", 1), (1, "b", 1), (2, "b", 1)}
    assert names.find_mentions(docs, words.where("entity = 4"), "id").count() == 0


def test_similar_names_of_many_ids_are_compared_once(spark, monkeypatch):
    """300 ids on either side share five names and four; pairs of ids used to be made for each word that they share."""
    kept = []
    monkeypatch.setattr(entities, "materialize", lambda df, name: kept.append((name, materialize(df, name))) or kept[-1][1], raising=False)
    left, right = ["red ring", "Red Ring!", "ring of red steel", "ringish", "", None], ["ring red", "blue bolt", "ring", "steelworks", "boltish of blue"]
    a, b = [(i, left[i % 6]) for i in range(300)], [(1000 + i, right[i % 5]) for i in range(300)]
    got = entities.similar_names(spark.createDataFrame(a, "id long, name string").repartition(3), spark.createDataFrame(b, "id long, name string").repartition(2)).collect()
    # what each name of the left finds, by its number and that of the right
    of = {(0, 0): 1.0, (0, 2): 0.5, (2, 0): 0.5, (2, 2): 0.25, (2, 3): 0.0, (3, 0): 0.0, (3, 2): 0.0}
    of |= {(1, y): v for (x, y), v in of.items() if x == 0}
    want = sorted((i, j, of[i % 6, (j - 1000) % 5]) for i, _ in a for j, _ in b if (i % 6, (j - 1000) % 5) in of)
    assert sorted(map(tuple, got)) == want
    assert [df.count() for name, df in kept if name == "similar"] == [7]
