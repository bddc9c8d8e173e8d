"""Each operator against a plain Python version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from orewright.llm import chat, fingerprints, language, media, mixing, neardup, quality, sentencepiece_op, tasks, token_files  # noqa: E402
from orewright.llm.pieces import MARK, WORD, PieceModel  # noqa: E402
from orewright.plans.shared import fresh_path, scratch  # noqa: E402

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, Score double"
WORDS = "the and attion thanedble of with a ion pathetic over".split()


def sentence(n, salt=0):
    return " ".join(WORDS[(i * i + i * salt + salt) % len(WORDS)] + str((i * 7 + salt) % 13) for i in range(n))


#: All shingles weigh 2.
ALIKE = neardup.Rarity(np.full(neardup.CELLS, 4096, np.uint16), 2.0)
TEXTS = [None, "", " ", "\n\n", "a", "Hello  world\nfoo 你\U0001f600 x ", "tab\there  \r\n é ñ Ω", MARK + "x" + MARK, "    four", "x" * 3000, sentence(40), sentence(40), sentence(60, 1), sentence(60, 1) + " end",
         sentence(3000, 3), "<|endoftext|> it's we'll <|im_end|>", "12 345", "\x00\x01 \x85", "ÀÉ ß <\\|x| \\n", "one.\nTwo three. Four!\nfive"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None, "a"][i % 4], 1, "clash", 0.5) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "a", 1, "c", 0.1), (3, "\n\n", "en", "a", 1, "clash", 0.5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sentencepiece_equals_the_library_and_decodes_back(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepiece_op.encode(docs, PIECES, check=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert list(r["ids"]) == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        if MARK not in (r["text"] or ""):  # the mark itself decodes to a blank, in the library too
            assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    model, seen = PieceModel.load(PIECES), {}
    worst = min(x for x, k in zip(model.scores, model.kinds) if k == 1) - 10

    def best(word):  # of all segmentations
        if word not in seen:
            top = [(0.0, 0)]
            for d in range(1, len(word) + 1):
                ways = [(top[k][0] + model.scores[model.vocab[word[k:d]]], top[k][1] + 1) for k in range(max(0, d - 20), d) if word[k:d] in model.vocab]
                top.append(max(ways + [(top[d - 1][0] + worst, top[d - 1][1] + len(word[d - 1].encode()))] * (word[d - 1] not in model.vocab), key=lambda w: w[0]))
            seen[word] = top[-1]
        return seen[word]

    for r in rows:
        words = WORD.findall((MARK + r["text"].replace(" ", MARK)) if r["text"] else "")
        if all(len(w) < 200 for w in words):
            assert math.isclose(r["viterbi_score"], sum(best(w)[0] for w in words), abs_tol=1e-6), r["text"]
    back = sentencepiece_op.decode(sentencepiece_op.encode(docs, PIECES), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "").replace(MARK, " ") for r in back)
    assert sentencepiece_op.encode(none, PIECES).count() == 0 and sentencepiece_op.decode(sentencepiece_op.encode(none, PIECES), PIECES).count() == 0


def test_token_counts(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = PieceModel.load(PIECES)
    for r in sentencepiece_op.count_tokens(docs, PIECES).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or ""))
        assert (r["n_tokens_unigram"] == 0) == (not r["text"])
    assert sentencepiece_op.count_tokens(none, PIECES).count() == 0
    # the unigram pass finds the best of all segmentations
    for word in (MARK + "hello", MARK + "thened", "über", "xq~"):
        ids = model.forward([word], "unigram", True)[0]
        best = {0: 0.0}
        for d in range(1, len(word) + 1):
            best[d] = max((best[k] + model.scores[model.vocab[word[k:d]]] for k in range(d) if word[k:d] in model.vocab), default=-1e18)
        assert math.isclose(sum(model.scores[i] for i in ids), best[len(word)])
    assert model.forward(sorted(["a", "ab", "abc", "b"]), "bpe", False) == [len(model.forward([w], "bpe", True)[0]) for w in ("a", "ab", "abc", "b")]


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rows = token_files.read_token_files(spark, token_files.write_token_files(docs, BYTES, partitions=5)).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = [*library.encode(texts[r["doc_id"]].pop() or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x)) and not any(texts.values())
    assert token_files.read_token_files(spark, token_files.write_token_files(none, BYTES)).count() == 0


def test_tables_of_other_tokenizer_files_and_of_few_words_equal_the_library():
    import json

    from tokenizers import Tokenizer

    with open(BYTES) as f:
        usual = json.load(f)
    spaced = usual | {"pre_tokenizer": usual["pre_tokenizer"] | {"add_prefix_space": True}}
    wide = usual | {"added_tokens": [*usual["added_tokens"], dict(usual["added_tokens"][0], id=50257, content="one two", special=False)]}
    texts = [t or "" for t in TEXTS] + [sentence(50, k) + " one two" for k in range(9)] + ["a\n b  c d\x00e f", "\x00", "\x01 x"]
    for spec, whole in ((usual, False), (spaced, True), (wide, True)):
        raw = json.dumps(spec)
        library, table = Tokenizer.from_str(raw), token_files.LibraryTable(raw.encode(), most=60)
        assert table.whole == whole
        for _ in range(3):  # words are forgotten and learnt again
            for a in range(0, len(texts), 5):
                ids, at = table.ids(pa.array(texts[a : a + 5]))
                assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts[a : a + 5]]


def test_mixing(spark, docs, none):
    many = spark.createDataFrame([(i, sentence(1 + i * i % 97, i), "en", [None, "a", "B", "c", "é"][i % 5] if i % 3 else "a", 1, "x", 0.0) for i in range(400)], SCHEMA)
    for table in (many, docs):
        rows = mixing.mix_sources(table, slim=True).collect()
        sizes = Counter()
        for r in table.collect():
            sizes[r["source"]] += len([w for w in (r["text"] or "").translate({c: " " for c in range(9, 14)}).split(" ") if w])
        order = sorted(sizes, key=lambda s: (s is None, s))
        weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
        target, free, rest = {}, set(order), float(sum(sizes.values()))
        while free:
            share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            target |= {s: 3.0 * sizes[s] for s in over} if over else share
            rest, free = rest - sum(3 * sizes[s] for s in over), free - over if over else set()
        taken = Counter()
        for r in rows:
            assert math.isclose(r["target"], target[r["source"]], abs_tol=1e-6) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
        biggest = max(r["size"] for r in rows)
        assert all(abs(taken[s] - target[s]) <= biggest for s in order)
        for source in order:  # the rates solve the dual, and copies are rates rounded
            own = [r for r in rows if r["source"] == source]
            mean = sizes[source] / len(own)
            low, high = -1e4, 1e4
            for _ in range(200 if sizes[source] else 0):
                lam = (low + high) / 2
                words = sum(r["size"] * min(3.0, math.exp(min(50.0, lam * r["size"] / mean))) for r in own)
                low, high = (lam, high) if words < target[source] else (low, lam)
            for r in own:
                if r["size"]:
                    assert abs(r["rate"] - min(3.0, math.exp(min(50.0, lam * r["size"] / mean)))) < 0.02 and abs(r["copies"] - r["rate"]) < 3
            if len(own) > 20:
                assert abs(sum(r["copies"] - r["rate"] for r in own)) <= 4
    with pytest.raises(RuntimeError):
        mixing.mix_sources(many, rounds=1)
    for table in (many, docs):
        rows = mixing.mix_sources(table, slim=True).collect()
        key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
        assert sorted(map(key, rows)) == sorted(map(key, mixing.mix_sources(table.repartition(7), slim=True).collect()))
    assert mixing.mix_sources(none).count() == 0
    assert set(mixing.mix_sources(docs).columns) >= set(docs.columns)


def lanes_of(spark, texts):
    """The lanes of each text, from the hashes of its paragraphs."""
    parts = {t: [p for p in re.split(fingerprints.PARAGRAPHS, t) if p.strip(" ")] for t in texts}
    table = spark.createDataFrame([(p,) for p in sorted({p for own in parts.values() for p in own})], "p string")
    hashes = {r["p"]: [x % 2**64 for x in r["h"]] for r in table.selectExpr("p", "array(xxhash64(0, p), xxhash64(1, p), xxhash64(2, p), xxhash64(3, p)) h").collect()}
    out = {}
    for t, own in parts.items():
        lanes = [sum(hashes[p][k] >> (j + 32 * half) & 1 for p in own) for k in (0, 1) for j in range(32) for half in (0, 1)]
        lanes += [sum(hashes[p][k] >> 32 * half & 0xFFFFFFFF for p in own) % 2**32 for k in (2, 3) for half in (0, 1)]
        out[t] = [*lanes, len(own)]
    return out


def like(a, b):
    x, y = ([2 * v - w[-1] for v in w[:128]] for w in (a, b))
    squares = sum(v * v for v in x) + sum(v * v for v in y)
    return 1.0 if a == b else 0.0 if not squares else min(1.0, max(0.0, 2 * sum(v * w for v, w in zip(x, y)) / squares))


def test_fingerprints(spark, docs, none):
    ids = docs.where("doc_id is null or doc_id <> 3")
    for given in ({}, {"range_bytes": 2000, "widest": 2}):
        rows = fingerprints.edited_fingerprints(ids, **given).collect()
        texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -math.inf), r["text"] or "") for r in ids.collect())
        assert len(rows) == len(texts)
        prints = {r["doc_id"] if r["doc_id"] is not None else -math.inf: r for r in rows}
        edits = []
        for i, (key, text) in enumerate(texts):
            k, follow = len(text) // 4, texts[(i + 1) % len(texts)][1]
            edits.append((key, text, text[: len(text) - k] + follow[:k], follow))
        lanes = lanes_of(spark, {t for e in edits for t in e[1:]})
        for key, text, edited, follow in edits:
            r = prints[key]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), key
            assert r["fingerprint"] == "".join(f"{v:08x}" for v in lanes[text]) and r["edited_fingerprint"] == "".join(f"{v:08x}" for v in lanes[edited])
            assert abs(r["near_edited"] - like(lanes[text], lanes[edited])) < 1e-9 and abs(r["near_next"] - like(lanes[text], lanes[follow])) < 1e-9
        assert prints[10]["fingerprint"] == prints[11]["fingerprint"] and prints[10]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(docs).count() == len(TEXTS) + 2  # a repeated id
    own = {r["doc_id"]: r["lanes"] for r in fingerprints.fingerprint(spark.createDataFrame([(1, "one. Two\nthree"), (2, "three\nTwo\none."), (3, "Two\nthree"), (4, "one."), (5, None)], "doc_id long, text string")).collect()}
    assert own[1] == own[2] and set(own[5]) == {0}  # order doesn't matter
    assert [(a + b) % 2**32 for a, b in zip(own[3], own[4])] == own[1]  # insertion adds
    assert fingerprints.edited_fingerprints(none).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def corpus(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        words = {"en": "the of and thing with", "de": "der und schön auf ich", "fr": "le été dans eaux où", "es": "el niño para ción qué"}[lang].split()
        bad = i % 6 == 0
        text = " ".join((words[(j * j + i) % 5] + words[(j + i) % 5][:2]).upper() + "!!" if bad else words[(j * j + i) % 5] + words[(j + i) % 5][:2] for j in range(20 + i % 30))
        rows.append((i, text, lang, "a", 1, "x", 0.0))
        if i % 3 != 1:
            labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_held_out_and_odd_rows(spark, docs, none):
    table, labels = corpus(spark)
    model = quality.train_quality(table, labels)
    rows = {r["doc_id"]: r for r in quality.score_quality(table, model).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([rows[i]["predicted"] == (i % 6 != 0) for i in held]) > 0.97
    odd = quality.score_quality(docs, model).collect()
    assert len(odd) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in odd)
    assert quality.score_quality(none, model).count() == 0
    untaught = quality.train_quality(table, labels.limit(0))
    assert {r["predicted"] for r in quality.score_quality(table, untaught).collect()} == {1}


def test_language_held_out_and_odd_rows(spark, docs, none):
    table, _ = corpus(spark)
    model = language.train_language(table)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    rows = {r["doc_id"]: r for r in language.predict_language(table, model).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([rows[i]["lang_pred"] == ("en", "de", "fr", "es")[i % 4] for i in held]) > 0.97
    for r in language.predict_language(docs, model).collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    marks = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(["½ ² Ⅷ", "①", "_ 5", "ª", "ß", "٣"])], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in sorted(language.predict_language(marks, model).collect(), key=lambda r: r["doc_id"])] == [True, True, True, False, False, True]
    # votes, one text at a time and one machine at a time
    texts = [r["text"] for r in table.limit(40).collect()]
    for text, lang in zip(texts, model.predict(language.trigrams(pa.array(texts)))[0], strict=True):
        x = np.append(language.trigrams(pa.array([text]))[0], 1)

        def winner(names, machines, x=x):
            won = {n: [0, 0.0] for n in names}
            for a, b in [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]:
                m = float(x @ machines[a, b])
                won[a if m >= 0 else b][0] += 1
                won[a][1] += math.tanh(m)
                won[b][1] -= math.tanh(m)
            return max(names, key=lambda n: (won[n][0], won[n][1]))

        assert lang == winner(model.families[winner(sorted(model.families), model.between)], model.within)
    assert language.predict_language(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict_language(docs, language.train_language(none)).collect()} == {"und"}


def test_media_round_trip_ranges_and_retries(spark, docs, none, tmp_path):
    root = fresh_path(spark, "media")
    media.write_archives(media.to_media(docs), root)
    rows = media.media_features(media.read_archives(spark, root, rangeBytes=700)).collect()
    expected = Counter((r["doc_id"], hashlib.sha256(media.pad((r["text"] or "").encode())).hexdigest(), len((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["payload_sha256"], r["n_bytes"]) for r in rows) == expected
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in rows)
    media.write_archives(media.to_media(none), root)
    assert media.read_archives(spark, root).count() == len(rows)
    # a member that fails at first is read again by its offset
    reader = media._Reader({"path": root, "retries": "2"})
    part = reader.partitions()[0]
    import zipfile

    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(root)
    path = f"{base}/{part.archive}"
    with zipfile.ZipFile(path) as z:
        member = z.infolist()[-1]
        good = z.read(member.filename)

    class Flaky:
        def __init__(self):
            self.left = 2

        def open_input_file(self, p):
            self.left -= 1
            if self.left >= 0:
                raise OSError("lost")
            return fs.open_input_file(p)

    assert reader.member(Flaky(), path, member) == good
    with pytest.raises(OSError):
        media._Reader({"path": root, "retries": "1"}).member(Flaky(), path, member)
    with pytest.raises(ValueError):
        media.from_picture(media.to_picture(b"abc")[:-20] + b"x" * 20)


def test_media_fields_from_the_bytes_alone(spark, docs):
    """All fields against a picture that is taken apart here: its header, its packed rows and their filters."""
    root = fresh_path(spark, "media-fields")
    media.write_archives(media.to_media(docs), root)
    got = defaultdict(list)
    for r in media.media_features(media.read_archives(spark, root)).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(TEXTS) + 2
    for doc in docs.collect():
        raw = (doc["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        png = media.to_picture(raw)
        assert png[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(png[16:20], "big") == 64 and png[24:26] == b"\x08\x00"
        at, packed = 8, b""
        while at < len(png):
            size = int.from_bytes(png[at : at + 4], "big")
            packed += png[at + 8 : at + 8 + size] if png[at + 4 : at + 8] == b"IDAT" else b""
            assert zlib.crc32(png[at + 4 : at + 8 + size]) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
            at += 12 + size
        rows, above, plain = zlib.decompress(packed), bytes(64), b""
        for k in range(0, len(rows), 65):
            kind, line = rows[k], bytearray(rows[k + 1 : k + 65])
            assert kind in (0, 1, 2)
            for i in range(64):
                line[i] = (line[i] + (0, line[i - 1] if i else 0, above[i])[kind]) % 256
            above = bytes(line)
            plain += above
        assert plain == payload
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest())
        assert want in [(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in got[doc["doc_id"]]]
    same = [r["feature"] for r in got[10] + got[11]]
    assert len(set(same)) == 1 and got[0][0]["feature"] == got[1][0]["feature"] != got[9][0]["feature"]


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, None, None, None), (3, 5, "a\nb\\n<|x", "<\\|y<\\\\|z |> <| é"), (3, 6, "assistant", ""), (3, 6, "assistant", "tie"), (None, 1, "assistant", "no id"), (4, 3000, "assistant", "late"), (4, 1, "user", "x" * 5000), (4, 1, "user", "x" * 5000)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t if t is not None else -math.inf, role or "", text or ""))
    for part in (8 << 20, 300, 40):
        got = chat.digest_chats(chat.format_chats(table, part_bytes=part)).collect()
        assert {r["conv_id"] for r in got} == set(groups) and len(got) == len(groups)
        for r in got:
            turns = sorted(groups[r["conv_id"]])
            loss = "".join(x for _, role, x in turns if role == "assistant")
            assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
            assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            if r["conv_id"] != 3:  # only 3 has something to escape in its roles
                guard = lambda x: re.sub(r"<(\\*)\|", r"<\\\1|", x)
                assert r["formatted_chars"] == sum(len("<|im_start|>\n<|im_end|>\n") + len(role) + len(guard(x)) for _, role, x in turns)
    assert chat.digest_chats(chat.format_chats(table.limit(0))).count() == 0


def classes(texts, threshold=0.8):
    """Least index of each text's class, by comparing all."""
    grams = []
    for t in texts:
        w = (t or "").split()
        grams.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(g for c in grams for g in c)
    weights = [{g: k * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, k in c.items()} for c in grams]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = weights[i], weights[j]
            low = sum(min(v, b[g]) for g, v in a.items() if g in b)
            high = sum(a.values()) + sum(b.values()) - low
            if (high == 0 or low / high >= threshold) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_near_duplicates_equal_brute_force(spark, none):
    base = [sentence(n, s) + f" tail{s} x{s} y{s}" for s, n in enumerate([30, 80, 150, 400, 12, 60])]
    texts = [None, "", "\n", "a b", "a  b", "a b c"]
    for s, t in enumerate(base):
        w = t.split()
        texts += [t, t, t + f" plus{s}", " ".join([*w[: len(w) // 2], "new", *w[len(w) // 2 :]]), " ".join(w[len(w) // 2 :]) + " other " * 9]
    texts += [" ".join(f"g{k}" for k in range(120)) + " " + " ".join(f"m{i}x{j}" for j in range(2)) for i in range(60)]  # a large group of near copies
    texts += ["shared words of a passage that many have " + " ".join(f"u{i}x{j}" for j in range(9)) for i in range(50)]  # and texts that share a passage only
    rows = spark.createDataFrame([(i, t, "en", "a", 1, "x", 0.0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(rows).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == classes(texts)
    assert sum(r["kept"] for r in got.values()) == len(set(classes(texts)))
    for other in (rows.repartition(7), rows.orderBy("text"), rows.coalesce(1)):  # the layout decides nothing
        assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(other).collect()} == {i: r["class_id"] for i, r in got.items()}
    assert neardup.near_duplicates(none).count() == 0


def test_document_frequencies_count_all_documents(spark):
    texts = [" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(60)] + [None, "", "x"] + [sentence(900)] * 5
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    df, n = Counter(), len(texts)
    row, h, _ = neardup.shingles(pa.array(texts))
    df.update(x for _, x in set(zip(row.tolist(), h.tolist())))
    for table, most in ((rows.repartition(5), 1), (rows.coalesce(1), 10**6), (rows.coalesce(1), 0)):
        with scratch(spark, "test") as own:
            rarity = neardup.document_frequencies(table, own, held_most=most)
        for x, k in df.items():
            assert abs(rarity.of(np.array([x], np.uint64))[0] - (math.log((1 + n) / (1 + k)) + 1)) < 0.001
        assert abs(rarity.top - (math.log((1 + n) / 2) + 1)) < 0.001


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rows = [(1, sentence(50)), (1, sentence(50)), (1, sentence(50, 2) + " q w e"), (None, sentence(50)), (4, sentence(50, 2) + " q w e"), (5, None), (6, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r["class_id"] for r in got if r["doc_id"] in (5, 6)} == {5} and {r["class_id"] for r in got if r["doc_id"] is None} == {None}
    assert [r["class_id"] for r in got if r["doc_id"] == 4] == [1]


def family(n, near):
    """Texts that share three quarters of their words, and for each of ``near`` a changed copy at the end."""
    words = [[f"g{k}" for k in range(150)] + [f"u{i}x{k}" for k in range(31)] for i in range(n)]
    return [" ".join(w) for w in words] + [" ".join([*words[i][:-5], *(f"v{i}x{k}" for k in range(5))]) for i in near]


def test_similarities_of_a_block_equal_brute_force():
    texts = [*family(40, [3, 7]), "a b c d e a b c d e a b c d e", "a b c d e a b c d e", sentence(300), sentence(290), "x y"]
    row, h, w, _ = neardup.weighted(pa.array(texts), ALIKE)
    held = [dict(zip(h[row == i], w[row == i], strict=True)) for i in range(len(texts))]
    got = neardup.similarities(pa.array(texts), ALIKE)
    for i, a in enumerate(held):
        for j, b in enumerate(held):
            low = sum(min(v, b[k]) for k, v in a.items() if k in b)
            assert abs(got[i, j] - low / (sum(a.values()) + sum(b.values()) - low)) < 1e-9


def test_all_near_pairs_of_a_large_bucket_are_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 100, raising=False)
    near = list(range(5, 400, 10))
    texts = family(400, near)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bucket = spark.createDataFrame([(i, i, i, i, [7]) for i in range(len(texts))], "k1 long, k2 long, least long, t long, bands array<long>")
    with scratch(spark, "test") as own:
        got = neardup._links(rows, bucket, 0.8, spark.sparkContext.broadcast(ALIKE), False, own).where("similarity >= 0.8").collect()
    assert {(r["a"], r["b"]) for r in got} == {(i, 400 + k) for k, i in enumerate(near)}


def test_consistent_samples_estimate_weighted_similarity():
    a, b = " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(20, 320))
    row, h, w, _ = neardup.weighted(pa.array([a, b]), ALIKE)
    same = []
    for salt in range(0, 600, 2):
        _, value = neardup._samples(h, w, row, 1000 + salt)
        same.append(value[0] == value[1])
    assert abs(np.mean(same) - 276 / 316) < 0.06


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    table, labels = corpus(spark)
    extra = [(1000 + i, r["text"], r["lang"], "b", 1) for i, r in enumerate(table.limit(20).collect())] + [(2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, "123 456", "en", "a", 7)]
    table.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r["doc_id"] for r in docs.collect()]
        assert set(after) <= before
        seen[name] = (before, set(after), len(after))
    assert not {i for i in range(0, 300, 6)} & seen["quality"][1] and len(seen["quality"][1] & {i for i in range(300) if i % 6}) > 240
    assert not {2000, 2001, 2002} & seen["language"][1] and seen["language"][1] >= seen["language"][0] - {2000, 2001, 2002}
    assert not {i for i in seen["near_duplicates"][1] if 1000 <= i < 2000} and 0 < seen["near_duplicates"][2] <= len(seen["near_duplicates"][0])
    assert "ids" in docs.columns and seen["tokens"][2] == seen["mix"][2]


def test_language_stage_rejects_what_is_no_learnt_language(spark):
    import corpus_pipeline

    table, _ = corpus(spark)
    rng = np.random.default_rng(1)
    letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(80)) for _ in range(10)]
    other = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."]
    odd = spark.createDataFrame([(5000 + i, x, None, "a", 1) for i, x in enumerate(letters + other)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = table.select(*corpus_pipeline.COLUMNS)
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, clean.unionByName(odd), "").collect()}
    ids = {r["doc_id"] for r in clean.collect()}
    assert len(got & ids) >= 0.98 * len(ids) and not got - ids


def test_near_duplicates_stage_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    texts = [sentence(50, s) + f" only{s}" for s in range(1, 5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (7, texts[2]), (7, texts[3]), (8, None), (9, " ")]
    docs = spark.createDataFrame([(i, x, "en", "a", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(0, texts[0]), (0, texts[1]), (3, texts[2]), (7, texts[3]), (8, "")])


def test_workers_keep_nothing_of_the_operator_before():
    tasks.serve("one")
    made = tasks.once("table", object)
    tasks.serve("one")
    assert tasks.once("table", object) is made
    tasks.serve("two")
    assert tasks.once("table", object) is not made


def test_counting_takes_memory_for_what_is_counted():
    cells = np.random.default_rng(1).integers(0, neardup.CELLS, 200_000).astype(np.uint32)
    cells[:50_000] = 7
    sums = np.zeros(neardup.CELLS, np.uint32)
    tracemalloc.start()
    neardup.count_into(sums, cells)
    neardup.count_into(sums, cells[:10])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(sums, np.bincount(np.concatenate([cells, cells[:10]]), minlength=neardup.CELLS))
    assert peak < 8 << 20  # a counter for each cell would be 32 MB
