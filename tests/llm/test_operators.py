"""Operators against brute force and on awkward tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import boilerplate, graph, langid, packing, pieces, rabitq, simhash, spotsigs, suffix, tokenstore, toxicity
from skein.llm.common import string_parts, words

KIND = "doc_id long, text string, lang string, source string, n_chars long, group_id string, node long, ids string"
LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [
    (1, "the quick fox runs over a lazy dog", "en", "s", 3, "g", 1, "x"), (1, "the quick fox runs over a lazy dog", "en", "s", 3, "g", 1, "x"), (None, "no id here at all", "en", None, None, None, None, None),
    (2, None, None, "s", 0, None, 1, None), (3, "", "en", "s", 0, "", 1, ""), (4, "... !!! ???", "en", "s", 0, "", 1, ""), (5, LONG, "en", "s", 0, "", 1, ""), (6, "été déjà ☃ 日本", "fr", "s", 0, "", 1, ""),
    (7, "one two\x00three\ttab", None, "s", 0, "", 1, ""), (5, "another text of document five", "en", "s", 0, "", 1, ""),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def corpus(seed: int, n: int, vocabulary: int = 400) -> list[tuple[int, str]]:
    """Texts with exact and near copies and shared passages."""
    r = random.Random(seed)
    v = [f"w{i}" for i in range(vocabulary)] + ["the", "of", "la", "der", "is"] * 20
    passages = [[r.choice(v) for _ in range(r.randint(40, 120))] for _ in range(8)]
    out: list[tuple[int, str]] = []
    for i in range(n):
        k = r.random()
        if out and k < 0.15:
            t = r.choice(out)[1].split()
        elif out and k < 0.35:
            t = [r.choice(v) if r.random() < 0.03 else w for w in r.choice(out)[1].split()]
        else:
            t = [r.choice(v) for _ in range(r.randint(5, 250))]
            if r.random() < 0.3:
                at = r.randint(0, len(t))
                t[at:at] = r.choice(passages)
        out.append((i, " ".join(t)))
    return out


def components_of(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# shared helpers

def test_words_hash_alike_everywhere():
    a = words(pa.array(["Foo bar, foo", None, "", "x", "bar"]), True)
    assert a.first.tolist() == [0, 3, 3, 3, 4, 5]
    assert a.hash[0] == a.hash[2] and a.hash[1] == a.hash[4] and len(set(a.hash.tolist())) == 3
    sliced = pa.array(["zzz", "Foo bar"])[1:]
    assert words(sliced, True).hash.tolist() == a.hash[:2].tolist()
    assert words(pa.array(["ab", "ab"])).hash.tolist() == [words(pa.array(["ab"])).hash[0]] * 2


def test_words_of_a_long_text_take_memory_in_proportion():
    import tracemalloc

    t = " ".join(f"word{i % 5000}" for i in range(1_000_000)) + " " + "x" * 1_000_000 + " end"
    tracemalloc.start()
    w = words(pa.array([t, "word1 end"]), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * len(t) and len(w.hash) == 1_000_004
    assert w.hash[1] == w.hash[-2] and w.hash[-3] == w.hash[-1]
    assert w.hash[1_000_000] == words(pa.array(["x" * 1_000_000]), True).hash[0] != words(pa.array(["x" * 999_999]), True).hash[0]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 400)]
    want = components_of(401, pairs)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(401))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1

def test_spotsigs_brute_force(spark):
    docs = corpus(3, 160)
    h, off = spotsigs.signatures(pa.array([t for _, t in docs]))
    sets = [set(h[a:b].tolist()) for a, b in zip(off[:-1], off[1:])]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if docs[i][1] == docs[j][1] or min(len(sets[i]), len(sets[j])) >= 3 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5]
    got = {x.doc_id: x.group_id for x in spotsigs.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert pairs and [got[i] for i in range(len(docs))] == components_of(len(docs), pairs)


def test_spotsigs_equal_texts_of_any_length(spark):
    rows = [(1, "one"), (2, "One!"), (3, "two words"), (4, "words two"), (5, "two, words"), (6, "..."), (7, "!!!"), (8, ""), (9, None), (10, None), (11, "the cat sat on mats"), (12, "The cat sat on mats."), (13, "cats see the cat sat on mats")]
    got = {x.doc_id: x.group_id for x in spotsigs.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11, 12: 11, 13: 13}


@pytest.mark.parametrize(("block", "window"), [(2, 1 << 20), (9, 12)])
def test_spotsigs_blocks_change_nothing(spark, monkeypatch, block, window):
    docs = spark.createDataFrame(corpus(3, 160), "doc_id long, text string")
    whole = sorted(map(tuple, spotsigs.groups(docs).collect()))
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    monkeypatch.setattr(spotsigs, "WINDOW_ROWS", window)
    assert sorted(map(tuple, spotsigs.groups(docs).collect())) == whole


def test_spotsigs_chains():
    h, off = spotsigs.signatures(pa.array(["the cat sat on mats", "THE cat, sat! the mats", "the cat"]))
    assert np.diff(off).tolist() == [1, 1, 0] and h[0] == h[1]


def test_spotsigs_awkward(awkward, nothing):
    rows = spotsigs.groups(awkward).collect()
    assert sorted(x.doc_id for x in rows) == [1, 2, 3, 4, 5, 6, 7] and all(x.kept for x in rows)
    assert spotsigs.groups(nothing).count() == 0


# 2

def cut_brute(docs: list[tuple[int, str]], least: int) -> dict[int, list[str]]:
    seen: set = set()
    out = {}
    for i, t in sorted(docs):
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - least + 1):
            run = tuple(w[j : j + least])
            if run in seen:
                gone[j : j + least] = [True] * least
            seen.add(run)
        out[i] = [x for x, g in zip(w, gone) if not g]
    return out


@pytest.mark.parametrize("batch_words", [1 << 20, 700])
def test_suffix_brute_force(spark, batch_words):
    docs = corpus(5, 120)
    docs.append((500, " ".join(["again"] * 130)))
    got = {x.doc_id: x.text.split() for x in suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), batch_words=batch_words).collect()}
    assert got == cut_brute(docs, suffix.MIN_WORDS)
    assert sum(map(len, got.values())) < sum(len(t.split()) for _, t in docs)


@pytest.mark.parametrize("hot", [1, 4, 20])
def test_suffix_hot_anchors_brute_force(spark, hot):
    """Anchors beyond hot occurrences are settled by their runs: the same words are cut."""
    docs = corpus(5, 120)
    line = " ".join(f"licence{i}" for i in range(45))
    docs += [(1000 + i, f"{' '.join(f'x{i}y{j}' for j in range(30))} {line} {' '.join(f'z{i}y{j}' for j in range(i % 9))}") for i in range(60)]
    docs += [(2000 + i, f"start{i % 3} " + " ".join(f"long{j}" for j in range(90))) for i in range(60)]
    docs.append((5000, " ".join(["again"] * 130)))
    got = {x.doc_id: x.text.split() for x in suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), hot=hot, batch_words=700).collect()}
    assert got == cut_brute(docs, suffix.MIN_WORDS)


def test_suffix_line_that_all_share(spark):
    """20 000 texts that share a line of 12 words and nothing else: no cuts, and no bucket of them."""
    import time

    from pyspark.sql import functions as F

    line = " ".join(f"line{i}" for i in range(12))
    docs = spark.range(20_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"a{j}b"), "id") for j in range(45)), F.lit(line), *(F.concat(F.lit(f"c{j}d"), "id") for j in range(45))).alias("text"))
    began = time.perf_counter()
    assert suffix.dedup(docs).where("cut_words > 0").count() == 0
    assert time.perf_counter() - began < 60


def test_suffix_clashing_names(spark):
    p = " ".join(f"p{i}" for i in range(70))
    rows = spark.createDataFrame([(1, p, 1, 2, 3, 4, 5), (2, p + " more", 1, 2, 3, 4, 5)], "doc_id long, text string, __cuts int, cuts int, __id int, nth int, `a.b` int")
    kept = suffix.drop_repeats(rows)
    assert kept.columns == rows.columns and {x.doc_id: x.text for x in kept.collect()} == {1: p, 2: "more"}


def test_suffix_rows_that_share_an_id(spark):
    p = " ".join(f"p{i}" for i in range(70))
    rows = [(1, p + " one"), (1, p + " two"), (2, p + " three"), (2, p + " three")]
    got = sorted((x.doc_id, x.cut_words) for x in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 70), (2, 70), (2, 70)]


def test_previous_factors_brute_force():
    r = np.random.default_rng(2)
    for _ in range(30):
        texts = [r.integers(0, 3, r.integers(1, 60)) for _ in range(r.integers(1, 6))]
        buckets = np.sort(r.integers(0, 2, len(texts)))
        word = np.concatenate(texts).astype(np.uint32)
        left = np.concatenate([np.arange(len(t), 0, -1) for t in texts])
        bucket = np.repeat(buckets, [len(t) for t in texts])
        got = suffix.previous_factors(word, left, bucket, 4)
        for i in range(len(word)):
            best = 0
            for j in range(i):
                k = 0
                while bucket[j] == bucket[i] and k < min(left[i], left[j]) and word[i + k] == word[j + k]:
                    k += 1
                best = max(best, k)
            want = best if best >= 4 else 0
            assert got[i] == want or (want > 4 and 4 <= got[i] <= want)


def test_suffix_awkward(spark, awkward, nothing):
    rows = suffix.dedup(awkward).collect()
    assert len(rows) == len(ROWS) and all(x.cut_words == 0 for x in rows)
    assert sorted(str(x.text) for x in rows) == sorted(str(x[1]) for x in ROWS)
    assert suffix.dedup(nothing).count() == 0
    kept = suffix.drop_repeats(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(ROWS)
    p = " ".join(f"p{i}" for i in range(70))
    two = spark.createDataFrame([(1, f"a. {p} b", 0), (2, f"c, {p}. D", 0), (3, p, 0), (None, p, 0)], "doc_id long, text string, n_chars long")
    assert {x.doc_id: (x.text, x.n_chars) for x in suffix.drop_repeats(two).collect()} == {1: (f"a. {p} b", 0), 2: ("c, D", 4), None: (p, 0)}


# 3 and 4

ENTRIES = [("<unk>", 0.0, 2), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *[(p, s, 1) for p, s in [("▁", -2.0), ("a", -3.0), ("b", -3.1), ("ab", -4.0), ("▁a", -4.5), ("▁ab", -5.2), ("ba", -4.4), ("abb", -6.0), ("é", -5.0), ("bé", -5.5), ("▁▁", -3.5), ("aab", -6.1)]]]


def best_score(text: str, scores: dict[bytes, float], unknown: float) -> float:
    b = (" " + text).encode()
    best = [0.0] + [-np.inf] * len(b)
    for i in range(len(b)):
        for p, s in scores.items():
            if b.startswith(p, i):
                best[i + len(p)] = max(best[i + len(p)], best[i] + s)
        size = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
        if b[i] & 0xC0 != 0x80 and b[i : i + size] not in scores:
            best[i + size] = max(best[i + size], best[i] + unknown)
    return best[-1]


def test_pieces_brute_force():
    own = pieces.Pieces(ENTRIES)
    scores = {p.replace("▁", " ").encode(): s for p, s, k in ENTRIES if k == 1}
    r = random.Random(4)
    texts = ["".join(r.choice("aabb é c☃") for _ in range(r.randint(1, 40))) for _ in range(200)]
    ids, off = own.encode(pa.array(texts))
    for t, a, b in zip(texts, off[:-1], off[1:]):
        got, run = 0.0, 0
        for i in ids[a:b]:
            kind = own.kinds[i]
            if kind == pieces.BYTE:
                got += own.unknown_score if run == 0 else 0
                first = int(own.bytes[own.begin[i]])
                run = (0 if first < 0x80 else 1 if first < 0xE0 else 2 if first < 0xF0 else 3) if run == 0 else run - 1
            else:
                got += dict((p, s) for p, s, _ in ENTRIES)[ENTRIES[i][0]]
        assert got == pytest.approx(best_score(t, scores, own.unknown_score))
    raw, at = own.decode(ids, off)
    assert [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == texts


def test_pieces_on_the_real_model(spark, awkward, nothing, sf):
    rows = pieces.encode(awkward, check=True)
    assert rows.count() == len(ROWS) and all(x.round_trip for x in rows.collect())
    back = sorted((str(x.text) for x in pieces.decode(rows).collect()))
    assert back == sorted(str(x[1] or "") for x in ROWS)
    assert pieces.encode(nothing).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert pieces.encode(docs, check=True).where("not round_trip").count() == 0


def test_pieces_batches_agree():
    own, fresh = pieces.Pieces(ENTRIES), pieces.Pieces(ENTRIES)
    a = own.encode(pa.array(["ab ba", "aab"]))[0].tolist()
    own.encode(pa.array(["bbb abab"]))
    assert own.encode(pa.array(["ab ba", "aab"]))[0].tolist() == a == fresh.encode(pa.array(["ab ba", "aab"]))[0].tolist()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, sf, tmp_path, encoding):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    path = str(tmp_path / encoding)
    encoded = tokenstore.encode_with_metadata(docs)
    tokenstore.write(encoded, path, encoding, row_group=64 << 10, page_rows=20)
    assert {x.doc_id: x.ids for x in tokenstore.tokens(spark, path).collect()} == {x.doc_id: x.ids for x in encoded.collect()}
    assert {x.doc_id for x in tokenstore.tokens(spark, path, 10, 19).collect()} == set(range(10, 20))
    meta = tokenstore.metadata(spark, path)
    assert "ids" not in meta.columns and "ids" not in meta._jdf.queryExecution().executedPlan().toString()
    file = pq.ParquetFile(next((tmp_path / encoding).glob("*.parquet")))
    assert file.metadata.num_row_groups > 1
    col = next(c for c in (file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)) if c.path_in_schema.startswith("ids"))
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in col.encodings
    assert file.metadata.row_group(0).column(0).has_offset_index and file.metadata.row_group(0).column(0).has_column_index


def test_token_store_range_read_opens_few_files(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(4000, numPartitions=8).selectExpr("id * 7919 % 4000 doc_id", "array(cast(id as int)) ids")
    for name, clustered in (("as it comes", False), ("clustered", True)):
        path = str(tmp_path / name)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tokenstore.write(rows, path, clustered=clustered)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spans = [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics for f in (tmp_path / name).glob("*.parquet")]
        met = sum(x.min <= 119 and x.max >= 100 for x in spans)
        assert len(spans) >= 4 and (met <= 2 if clustered else met == len(spans))
        assert sorted(r.doc_id for r in tokenstore.tokens(spark, path, 100, 119).collect()) == list(range(100, 120))


def test_token_store_without_metadata(spark):
    rows = tokenstore.encode_with_metadata(spark.createDataFrame([(1, "a b", 2), (1, "a b", 2), (None, None, 3)], "doc_id long, text string, other int")).collect()
    assert [(r.doc_id, r.lang, r.source, r.n_tokens) for r in rows] == [(1, None, None, 2), (1, None, None, 2), (None, None, None, 0)]


def test_token_store_awkward(spark, awkward, nothing, tmp_path):
    tokenstore.write(tokenstore.encode_with_metadata(awkward), str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a")).collect()
    assert len(rows) == len(ROWS) and {x.n_tokens for x in rows if x.doc_id in (2, 3)} == {0}
    tokenstore.write(tokenstore.encode_with_metadata(nothing), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        tokenstore.options("other")


# 5

GOOD = "It was the best of the days that we had in all of the year, and it was also the one that they said would be the last for him and her, as there was no other way for them to come out of the valley with all of that but over the hills."


def test_boilerplate():
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us here</a></li></ul><h1>Short head</h1><p>{GOOD}</p><p>Short one.</p><p>{GOOD}&amp; more</p><div>Copyright © 2020 all the rights of the owner are with the owner</div><p>tail bit</p></body>"
    text, n, good = boilerplate.extract(page)
    assert text.split("\n") == ["Short head", GOOD, "Short one.", GOOD + "& more"] and good == 4 and n == 8


def extract_brute(page: str) -> tuple[str, int, int]:
    """The same rules over the standard library's parser, each neighbour looked up anew."""
    import re
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.text, self.linked, self.links, self.skip, self.heading = [], "", 0, 0, 0, False

        def close_block(self):
            text = " ".join(self.text.split())
            if text:
                self.found.append((text, min(self.linked, len(text)), self.heading))
            self.text, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "noscript", "svg", "template", "title"):
                self.skip += 1
                self.text += " "  # what is skipped parts words
            elif not self.skip:
                self.tag(tag, True)

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript", "svg", "template", "title"):
                self.skip = max(0, self.skip - 1)
            elif not self.skip:
                self.tag(tag, False)

        def tag(self, name, begins):
            if name == "a":
                self.links = self.links + 1 if begins else max(0, self.links - 1)
            elif name in boilerplate._BLOCK:
                self.close_block()
                if re.fullmatch("h[1-6]", name):
                    self.heading = begins

        def handle_comment(self, data):
            self.text += " "

        def handle_data(self, data):
            if not self.skip:
                self.text += data
                self.linked += len(" ".join(data.split())) * (self.links > 0)

    r = Reader()
    r.feed(page)
    r.close()
    r.close_block()
    labels = []
    for text, linked, _ in r.found:
        words_ = re.findall(r"[^\W\d_]+", text.lower())
        density = max(sum(w in s for w in words_) for s in map(set, boilerplate.STOPWORDS.values())) / len(words_) if words_ else 0
        if linked > 0.2 * len(text) or "\u00a9" in text:
            labels.append("bad")
        elif len(text) < 70:
            labels.append("bad" if linked else "short")
        else:
            labels.append(("good" if len(text) > 200 else "neargood") if density >= 0.25 else "neargood" if density >= 0.2 else "bad")

    def near(kinds, i, step, wanted):
        i += step
        while 0 <= i < len(kinds):
            if kinds[i] in wanted:
                return kinds[i]
            i += step
        return "bad"

    one = list(labels)
    for i, k in enumerate(labels):
        if k == "short":
            sides = [(near(labels, i, d, ("good", "bad")), near(labels, i, d, ("good", "bad", "neargood"))) for d in (-1, 1)]
            one[i] = sides[0][0] if sides[0][0] == sides[1][0] else "good" if ("bad", "neargood") in sides else "bad"
    two = ["good" if k == "neargood" and "good" in (near(one, i, -1, ("good", "bad")), near(one, i, 1, ("good", "bad"))) else "bad" if k == "neargood" else k for i, k in enumerate(one)]
    for i, (_, _, heading) in enumerate(r.found):
        if heading and labels[i] == "short" and two[i + 1 : i + 2] == ["good"]:
            two[i] = "good"
    good = [t for (t, _, _), k in zip(r.found, two) if k == "good"]
    return "\n".join(good), len(r.found), len(good)


def test_boilerplate_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_blocks, r.n_good) for r in boilerplate.extract_pages(spark.createDataFrame(rows)).collect()}
    assert got == {r.page_id: extract_brute(r.html) for r in rows}
    r = random.Random(3)
    bits = ["<p>", "</p>", GOOD, "short bit", "<a href='x>y'>", "</a>", '<div data-x="1 > 2">', "</div>", "<h2>", "</h2>", " and the of", "&amp;", "<br>", "<!-- x -->", "<script>if (a<b) c</script>", "<title>t</title>"]
    for _ in range(300):
        page = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        assert boilerplate.extract(page) == extract_brute(page)


def test_boilerplate_open_head_and_hostile_pages():
    import time

    assert boilerplate.extract(f"<html><head><title>T</title><body><p>{GOOD}</p>") == (GOOD, 1, 1)
    began = time.perf_counter()
    for page in ("<a " * 1_600_000, "<! " * 1_600_000, "<![CDATA[" * 500_000, "<script " * 600_000, '<a "' * 1_200_000, "<a ='" * 1_000_000, "<!--" * 1_200_000, "<a" + " " * 5_000_000):
        boilerplate.extract(page)
    assert time.perf_counter() - began < 60


def test_boilerplate_passes():
    assert boilerplate.second_pass(["good", "short", "good"]) == ["good"] * 3
    assert boilerplate.second_pass(["bad", "short", "good"]) == ["bad", "bad", "good"]
    assert boilerplate.second_pass(["bad", "neargood", "short", "good"]) == ["bad", "good", "good", "good"]
    assert boilerplate.second_pass(["bad", "neargood", "bad"]) == ["bad"] * 3
    assert boilerplate.second_pass([]) == [] and boilerplate.second_pass(["short"]) == ["bad"]
    assert boilerplate.first_pass("x" * 30, 0) == "short" and boilerplate.first_pass("x" * 30, 20) == "bad" and boilerplate.first_pass(GOOD, 0) == "good" and boilerplate.first_pass("zzz " * 60, 0) == "bad"


def test_boilerplate_awkward(spark, nothing):
    rows = [(1, None, "u"), (1, None, "u"), (None, "", "u"), (2, "<p>" + GOOD, "u"), (3, "<!-- open", "u"), (4, "<p>" + GOOD * 2000, "u"), (5, "plain < text", "u"), (6, "<script>var a", "u"), (7, "a <b", "u")]
    got = boilerplate.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(got) == len(rows) and {x.page_id: x.n_good for x in got if x.page_id} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0}
    assert boilerplate.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


# 6

def ppm_bits(samples: list[str], text: str, order: int) -> float:
    counts: dict[bytes, dict[int, int]] = {}
    for s in samples:
        b = s.encode()
        for i, x in enumerate(b):
            for k in range(min(i, order) + 1):
                c = counts.setdefault(b[i - k : i], {})
                c[x] = c.get(x, 0) + 1
    total = 0.0
    b = text.encode()
    for i, x in enumerate(b):
        for k in range(min(i, order), -1, -1):
            c = counts.get(b[i - k : i])
            if c:
                n, kinds = sum(c.values()), len(c)
                if x in c:
                    total += np.log2((n + kinds) / c[x])
                    break
                total += np.log2((n + kinds) / kinds)
        else:
            total += 8
    return total


def test_langid_brute_force():
    samples = {"en": ["the cat and the dog", "a thing of the past"], "fr": ["le chat et le chien", "été déjà"]}
    model = langid.fit(samples)
    texts = ["the chat", "zzz ☃ the", "", "e", "the dog and le chien " * 60]
    bits = langid.code_lengths(model, *string_parts(pa.array(texts)))
    for i, t in enumerate(texts):
        for l, name in enumerate(model.langs):
            assert bits[i, l] == pytest.approx(ppm_bits(samples[name], t, model.order), rel=1e-5, abs=1e-3)


def test_langid_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("doc_id", "lang").withColumnRenamed("lang", "truth")
    got = langid.identify(docs, model).join(held, "doc_id").collect()
    assert np.mean([x.lang == x.truth for x in got]) >= 0.95 and np.mean([x.accepted for x in got]) >= 0.98


def test_langid_awkward(spark, awkward, nothing):
    model = langid.train(awkward)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == len(ROWS) and {x.lang for x in rows if x.doc_id in (2, 3)} == {"und"} and not any(x.accepted for x in rows if x.doc_id in (2, 3))
    kept = langid.keep_known(awkward, model)
    assert kept.columns == awkward.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in rows if x.accepted}
    empty = langid.train(nothing)
    assert langid.identify(nothing, empty).count() == 0 and langid.identify(awkward, empty).where("accepted").count() == 0


# 7

def pack_brute(tokens: list[int], boundary: list[bool], capacity: int, truncation: int, split: int) -> int:
    n = len(tokens)
    best = [0] + [10**9] * n
    for j in range(1, n + 1):
        for i in range(j):
            size = sum(tokens[i:j])
            if sum(tokens[i : j - 1]) >= capacity and size > capacity:
                continue
            cost = capacity - size if size <= capacity else truncation * (size - capacity)
            best[j] = min(best[j], best[i] + cost + (0 if boundary[j - 1] or j == n else split))
    return best[n]


def test_packing_brute_force():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(0, 25)
        tokens, boundary = [r.choice([0, r.randint(1, 9), r.randint(1, 40)]) for _ in range(n)], [r.random() < 0.4 for _ in range(n)]
        cost, ends = packing.cuts(tokens, boundary, 20, 3, 5)
        assert cost == pack_brute(tokens, boundary, 20, 3, 5)
        assert ends == sorted(set(ends)) and (ends[-1:] == [n] if n else not ends)


def test_packing_accounts_for_all_tokens(spark, sf, awkward, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    windows = packing.pack(docs).collect()
    size = {x.doc_id: x.n_tokens for x in pieces.encode(docs).collect()}
    assert sum(x.n_tokens + x.truncated for x in windows) == sum(size.values())
    assert all(x.n_tokens + x.padding == packing.CAPACITY and sum(x.tokens) == x.n_tokens for x in windows)
    order = [d for x in sorted(windows, key=lambda x: (x.shard, x.window)) for d in x.doc_ids]
    assert order == sorted(order) and set(order) == {d for d, n in size.items() if n}
    ids = [d for x in packing.pack(awkward).collect() for d in x.doc_ids]
    assert set(ids) == {1, 4, 5, 6, 7} and packing.pack(nothing).count() == 0
    assert sum(x.truncated for x in packing.pack(awkward).collect()) < 100


def test_long_words_split_alike():
    own = pieces.Pieces.load(pieces.MODEL)
    r = random.Random(5)
    for letters in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ab", "日本語中文字éü"):
        raw = np.frombuffer((" " + "".join(r.choice(letters) for _ in range(7000))).encode(), np.uint8)
        plain = own._split(raw, np.array([0]), np.array([len(raw)]))
        for got in (own.split_words(raw, np.array([0]), np.array([len(raw)])), own._split_one(raw.tobytes())):
            assert np.array_equal(plain[0], got[0]) and plain[1].tolist() == got[1].tolist()


def test_megabytes_without_a_space():
    import time

    own = pieces.Pieces.load(pieces.MODEL)
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(2_000_000)), "a" * 300_000, "".join(r.choice("日本語中文字") for _ in range(200_000))]
    began = time.perf_counter()
    for t in texts:
        raw, _ = own.decode(*own.encode(pa.array([t])))
        assert raw.tobytes().decode() == t
    assert time.perf_counter() - began < 60


def test_packing_windows_hold_the_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {x.doc_id: x.ids for x in pieces.encode(docs).collect()}
    for capacity, shard_docs, solve_tokens in ((64, 20, 1000), (packing.CAPACITY, packing.SHARD_DOCS, packing.SOLVE_TOKENS)):
        windows = sorted(packing.pack(docs, capacity, shard_docs=shard_docs, solve_tokens=solve_tokens).collect(), key=lambda x: (x.shard, x.window))
        assert len({(x.shard, x.window) for x in windows}) == len(windows)
        got: dict[int, dict[int, int]] = {}
        lost = 0
        for x in windows:
            assert len(x.ids) == x.n_tokens == sum(x.tokens) <= capacity
            lost += x.truncated
            at = 0
            for d, first, n in zip(x.doc_ids, x.first_token, x.tokens):
                got.setdefault(d, {}).update(zip(range(first, first + n), x.ids[at : at + n]))
                at += n
        assert all(want[d][i] == t for d, tokens in got.items() for i, t in tokens.items())
        assert sum(map(len, got.values())) + lost == sum(map(len, want.values()))
        order = [d for x in windows for d in x.doc_ids]
        assert order == sorted(order)
    back = {x.doc_id: x.text for x in pieces.decode(spark.createDataFrame([(d, [t for _, t in sorted(tokens.items())]) for d, tokens in got.items() if len(tokens) == len(want[d])], "doc_id long, ids array<int>")).collect()}
    text = {x.doc_id: x.text for x in docs.collect()}
    assert len(back) >= 150 and all(text[d] == t for d, t in back.items())


def test_packing_sparse_ids_share_windows(spark):
    rows = [(i, f"text number {i}. It is short.") for i in range(50)]
    near = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    far = packing.pack(spark.createDataFrame([(i * 1_000_003, t) for i, t in rows], "doc_id long, text string")).collect()
    assert len(near) == len(far) == 1 and near[0].ids == far[0].ids


# 8

def toxic_world(seed: int):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(500)]
    bad = ["scumbag", "moronic", "idiotic", "worthless", "pathetic", "trashy"]

    def text(p: float) -> str:
        return " ".join(r.choice(bad) if r.random() < p else r.choice(plain) for _ in range(r.randint(60, 200)))

    return [text(0.05) for _ in range(400)], [text(0) for _ in range(900)]


def test_toxicity_held_out():
    bad, good = toxic_world(7)
    model = toxicity.fit(bad[:200], good[:600])
    rate = lambda x: np.mean(toxicity.scores(model, pa.array(x))[0] >= model.threshold)
    assert rate(bad[200:]) >= 0.95 and rate(good[600:]) <= 0.02


def test_toxicity_fit_brute_force():
    from collections import Counter

    from skein.llm.common import hash_word

    bad, good = toxic_world(9)
    bad, good = bad[:120], good[:200]
    n, m = (Counter(w for t in x for w in set(t.split())) for x in (bad, good))
    want = {w for w in n if n[w] >= toxicity.LEAST_TEXTS and n[w] / len(bad) >= toxicity.LEAST_RATIO * (m[w] + 0.5) / len(good)}
    assert want and set(toxicity.telling_words(bad, good).tolist()) == {hash_word(w) for w in want}
    r = np.random.default_rng(1)
    for _ in range(50):
        x, y = r.integers(0, 12, r.integers(1, 30)) / 4, r.integers(0, 6, r.integers(0, 30)) / 4
        cuts = sorted({c for c in [*x, *y] if c > 0})
        errors = [np.mean(x < c) + 3 * (np.mean(y >= c) if len(y) else 0) for c in cuts]
        assert toxicity._cut(x, y) == (cuts[int(np.argmin(np.round(errors, 12)))] if cuts else np.inf)
    model = toxicity.fit(bad, good)
    half = toxicity._apart_from_copies(bad)[1::2], toxicity._apart_from_copies(good)[1::2]
    assert model.threshold == toxicity._cut(*(toxicity.scores(model, pa.array(x))[0] for x in half))


def test_toxicity_equal_to_the_threshold_is_toxic():
    model = toxicity.ToxicModel(b"", b"", 0.5, 7)
    assert toxicity._toxic(model, np.array([0.5, 0.49, 0.49]), np.array([0, 7, 6])).tolist() == [True, True, False]


def test_dictionaries_keep_all_that_was_trained():
    v = simhash.mix(np.arange(40, dtype=np.uint64))
    few = toxicity._dictionary(v, 8, 160)
    assert few == v[-20:].tobytes()  # too little to train on: the last of it
    trained = toxicity._dictionary(np.tile(v, 400), 8, 2048)
    assert trained[:4] == bytes.fromhex("37a430ec") and sum(x.tobytes() in trained for x in v) >= 36


def test_toxicity_without_toxic_labels_warns(spark, awkward):
    with pytest.warns(UserWarning, match="toxic"):
        model = toxicity.train(awkward, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.classify(awkward, model).where("toxic").count() == 0


def test_langid_ties_go_to_the_first_language():
    model = langid.fit({"b": ["same text here"], "a": ["same text here"]})
    raw, offsets = string_parts(pa.array(["same text"]))
    assert model.langs[langid.decide(model, langid.code_lengths(model, raw, offsets), np.diff(offsets), 8.0)[0][0]] == "a"


def test_pieces_ties_go_to_the_longer_last_piece():
    own = pieces.Pieces([("<unk>", 0.0, 2), ("a", -1.0, 1), ("aa", -2.0, 1), ("\u2581", -1.0, 1)])
    assert own.encode(pa.array(["aa"]))[0].tolist() == [3, 2]


def test_packing_ties():
    assert packing.cuts([4, 4, 4], [True, True, True], 8, 4, 16)[1] in ([1, 3], [2, 3])
    cost, ends = packing.cuts([4, 4], [True, True], 8, 4, 16)
    assert (cost, ends) == (0, [2])  # the longer window
    assert packing.cuts([5, 4], [True, True], 8, 7, 16) == (7, [1, 2])  # 7 padding or 7 lost: the one that isn't truncated


def test_toxicity_scores_are_compressed_lengths():
    model = toxicity.fit(*toxic_world(8))
    plain, toxic = model.compressors()
    text = " ".join(["idiotic", "abc", "pathetic"] * 20)
    rate, hits, n, top = toxicity.scores(model, pa.array([text, "", None]))
    h = words(pa.array([text]), True).hash
    saved = [len(plain.compress(h[i : i + 16].tobytes())) - len(toxic.compress(h[i : i + 16].tobytes())) for i in range(0, 60, 16)]
    assert n.tolist() == [4, 0, 0] and top[0] == max(saved) and hits[0] == sum(s >= 3 for s in saved)
    assert rate[0] == pytest.approx(sum(s for s in saved if s >= 3) / 60) and rate[1] == rate[2] == 0


def test_toxic_passage_in_a_long_clean_text(spark):
    bad, good = toxic_world(7)
    model = toxicity.fit(bad[:200], good[:600])
    clean = [" ".join(good[600 + 20 * k : 620 + 20 * k]) for k in range(15)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([f"{c[: len(c) // 2]} {p} {c[len(c) // 2 :]}" for c, p in zip(clean, [t for t in bad[200:] if len(t.split()) >= 128])] + clean)], "doc_id long, text string")
    found = {x.doc_id for x in toxicity.classify(docs, model).collect() if x.toxic}
    assert len(found & set(range(15))) >= 13 and len(found - set(range(15))) <= 1
    assert {x.doc_id for x in toxicity.drop_toxic(docs, model).collect()} == set(range(30)) - found


def test_toxicity_dictionary_sees_the_whole_sample():
    r = np.random.default_rng(8)
    n, v = 650_000, simhash.mix(np.arange(100, dtype=np.uint64))
    held = toxicity._dictionary(np.concatenate([v[r.integers(0, 50, n)], v[r.integers(50, 100, n)]]), 16, toxicity.ORDINARY_DICT)
    assert all(sum(x.tobytes() in held for x in half) >= 40 for half in (v[:50], v[50:]))
    assert toxicity.SAMPLE_ORDINARY >= 6000


def test_toxicity_large_sample_stays_in_the_table(spark, monkeypatch):
    bad, good = toxic_world(7)
    texts = [" ".join([t] * 3) for t in bad[:200] + good[:600]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(800)], "doc_id long, toxic int")
    want = toxicity.fit(texts[:200], texts[200:])
    assert toxicity.train(docs, labels) == want
    monkeypatch.setattr(toxicity, "LOCAL_BYTES", 0)
    monkeypatch.setattr(toxicity, "DICTIONARY_RUNS", 300)
    few, collect, got = toxicity.fit(texts[:200], texts[200:]), type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda df: got.append(collect(df)) or got[-1])
    assert toxicity.train(docs, labels) == few
    came = [x for rows in got for r in rows for x in r if isinstance(x, str | bytes)]
    assert few != want and not set(texts) & set(came) and sum(map(len, came)) < sum(map(len, texts)) / 2


def test_toxicity_sample_is_bounded_where_rows_share_ids(spark, monkeypatch):
    bad, good = toxic_world(7)
    docs = spark.createDataFrame([(i % 2, t) for i, t in enumerate(bad[:60] + good[:60])] + [(1, bad[1])] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 20)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 30)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda *x: seen.extend(x))
    toxicity.train(docs, labels)
    assert [len(x) for x in seen] == [len(set(x)) for x in seen] == [20, 30]
    assert set(seen[0]) <= set((bad[:60] + good[:60])[1::2]) and set(seen[1]) <= set((bad[:60] + good[:60])[::2])


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, 0), (99, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    rows = toxicity.classify(awkward, model).collect()
    assert len(rows) == len(ROWS) and not any(x.toxic for x in rows if x.doc_id in (2, 3))
    assert toxicity.drop_toxic(awkward, model).columns == awkward.columns
    empty = toxicity.train(nothing, labels.where("false"))
    assert toxicity.classify(nothing, empty).count() == 0 and toxicity.drop_toxic(awkward, empty).count() == len(ROWS)


# 9

def test_fingerprints_brute_force():
    texts = ["Alpha beta gamma", "beta ALPHA, gamma gamma", "", None, " ".join(f"t{i}" for i in range(700))]
    got, count = simhash.fingerprints(pa.array(texts))
    assert count.tolist() == [3, 3, 0, 0, 700] and np.array_equal(got[0], got[1])
    w = words(pa.array(texts), True)
    for row in (0, 4):
        h = np.unique(w.hash[w.first[row] : w.first[row + 1]] >> np.uint64(24))
        for k in range(4):
            with np.errstate(over="ignore"):
                x = simhash.mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > len(h)
            assert np.array_equal(np.packbits(bits).view(np.uint64)[0], got[row, k])


@pytest.mark.parametrize("radius", [0, 3, 44, 127])
def test_bit_sliced_distances(radius):
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    near = base[r.integers(0, 40, 300)].copy()
    for row in near:
        for b in r.integers(0, 256, r.integers(0, 60)):
            row[b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    start = np.unique(np.concatenate([[0], r.integers(1, 300, 12)]))
    end = np.append(start[1:], 300)
    want = [(i, j) for a, b in zip(start, end) for i in range(a, b) for j in range(a, i) if np.bitwise_count(near[i] ^ near[j]).sum() <= radius]
    assert simhash.near_in_buckets(near, start, radius).tolist() == components_of(300, want)
    whole = [(i, j) for i in range(300) for j in range(i) if np.bitwise_count(near[i] ^ near[j]).sum() <= radius]
    assert simhash.near_in_buckets(near, np.array([0]), radius).tolist() == components_of(300, whole)


def test_simhash_bands_reach_the_radius():
    r = np.random.default_rng(3)
    a = r.integers(0, 2, (2000, simhash.BITS))
    b = a.copy()
    for row in b:
        row[r.permutation(simhash.BITS)[: simhash.RADIUS]] ^= 1
    assert np.mean([(a[:, p] == b[:, p]).all(axis=1) for p in simhash.band_positions()], axis=0).astype(bool).mean() >= 0.88


@pytest.mark.parametrize("rows", [1, 10**6, 10**9])
@pytest.mark.parametrize("radius", [20, 44, 60])
def test_simhash_bands_follow_rows_and_radius(rows, radius):
    bits, bands = simhash.plan_bands(rows, radius)
    assert bits >= simhash.LEAST_BITS and rows / 2**bits <= simhash.BUCKET
    assert 1 - (1 - (1 - radius / simhash.BITS) ** bits) ** bands >= simhash.RECALL
    if bands <= 200:
        r = np.random.default_rng(3)
        a = r.integers(0, 2, (1000, simhash.BITS))
        b = a.copy()
        for row in b:
            row[r.permutation(simhash.BITS)[:radius]] ^= 1
        assert np.mean([(a[:, p] == b[:, p]).all(axis=1) for p in simhash.band_positions(bits, bands)], axis=0).astype(bool).mean() >= 0.96


def test_simhash_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(11, 200), "doc_id long, text string")
    whole = sorted(map(tuple, simhash.groups(docs).collect()))
    monkeypatch.setattr(simhash, "BLOCK", 3)
    assert sorted(map(tuple, simhash.groups(docs).collect())) == whole


def test_simhash_clashing_names(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, t, 1, 2, 3, 4, 5), (2, t, 1, 2, 3, 4, 5), (None, t, 1, 2, 3, 4, 5)], "doc_id long, text string, __gone int, __nth int, id int, `row` int, `a.b` int")
    kept = simhash.keep_first(rows)
    assert kept.columns == rows.columns and sorted(map(str, kept.collect())) == sorted(map(str, rows.where("doc_id is null or doc_id = 1").collect()))


def test_simhash_recall(spark):
    docs = corpus(11, 300)
    p, _ = simhash.fingerprints(pa.array([t for _, t in docs]))
    pairs = [(i, j) for i in range(len(p)) for j in range(i) if np.bitwise_count(p[i] ^ p[j]).sum() <= simhash.RADIUS]
    want = components_of(len(p), pairs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.group_id for x in simhash.groups(df).collect()}
    assert np.mean([got[i] == want[i] for i in range(len(p))]) >= 0.97
    assert {x.doc_id for x in simhash.keep_first(df).collect()} == {i for i in got if got[i] == i}


def test_simhash_awkward(awkward, nothing):
    rows = simhash.groups(awkward).collect()
    assert sorted(x.doc_id for x in rows) == [1, 5, 6, 7] and all(x.kept for x in rows)
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert simhash.groups(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


# 10

def vectors(seed: int, n: int, dim: int):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[n // 2 :] = x[r.integers(0, n // 2, n - n // 2)] + r.standard_normal((n - n // 2, dim)) * 0.15
    return x


@pytest.mark.parametrize("dim", [64, 100])
def test_rabitq_recall_and_precision(spark, dim):
    x = vectors(3, 400, dim)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= rabitq.THRESHOLD, 1)))}
    rows = rabitq.near_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    got = {(r.id_a, r.id_b) for r in rows}
    assert got <= want and len(got) >= 0.95 * len(want) > 0
    assert all(abs(r.cosine - s[r.id_a, r.id_b]) < 1e-6 for r in rows)


def test_rabitq_estimates():
    x = vectors(5, 600, 128)
    centre = (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(axis=0)
    c = rabitq.Codes(x, centre)
    i, j = np.random.default_rng(1).integers(0, 600, (2, 5000))
    at = {f: getattr(c, f) for f in (*rabitq._FIXED, "bits", "planes")}
    cosine, error = rabitq.estimate(at, i, j, c.wide, float(centre @ centre))
    true = (x[i] * x[j]).sum(axis=1) / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(x[j], axis=1))
    off = (cosine - true)[i != j]
    assert abs(off.mean()) < 0.005 and np.mean(np.abs(off) <= rabitq.SIGMAS * error[i != j]) > 0.999


def test_rabitq_awkward(spark):
    kind = "vec_id long, embedding array<float>, id long, band string"
    v = [0.1 * i for i in range(1, 9)]
    rows = [(1, v, 1, ""), (2, v, 1, ""), (2, v, 1, ""), (None, v, 1, ""), (3, None, 1, ""), (4, [], 1, ""), (5, [0.0] * 8, 1, ""), (6, [float("nan")] * 8, 1, ""), (7, v[:3], 1, ""), (8, [None] * 8, 1, ""), (9, [-x for x in v], 1, "")]
    assert [tuple(r) for r in rabitq.near_pairs(spark.createDataFrame(rows, kind)).collect()] == [(1, 2, 1.0)]
    assert rabitq.near_pairs(spark.createDataFrame([], kind)).count() == 0


def test_rabitq_every_length(spark):
    v = [0.1 * i for i in range(1, 9)]
    rows = [(1, v), (2, v), (3, v), (4, v[:3]), (5, v[:3]), (6, v[:3] + v[:3]), (7, [-x for x in v[:3]])]
    found = rabitq.near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (4, 5, 1.0)]


def test_rabitq_groups_brute_force(spark):
    x = vectors(4, 300, 64)
    x[250:] = x[np.random.default_rng(5).integers(0, 20, 50)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    least = [int(np.flatnonzero((x == v).all(axis=1))[0]) for v in x]
    reps = sorted(set(least))
    links = {i: {j for j in reps if j != i and s[i, j] >= rabitq.THRESHOLD} for i in reps}
    root = components_of(len(x), [(i, j) for i in reps for j in links[i]] + list(enumerate(least)))
    rows = rabitq.groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), recall=0.9999).collect()
    assert sum(map(len, links.values())) and {r.vec_id: (r.class_id, r.n_links, r.group_id, r.kept) for r in rows} == {i: (least[i], len(links[least[i]]), root[i], root[i] == i) for i in range(len(x))}


def test_rabitq_groups_of_copies_and_odd_rows(spark):
    v = [0.1 * i for i in range(1, 9)]
    rows = [(i, v) for i in range(300)] + [(400, v[:3]), (401, v[:3]), (402, None), (403, []), (404, [0.0] * 8), (405, [float("nan")] * 8), (None, v), (406, v), (406, [-a for a in v]), (407, [-a for a in v])]
    got = {r.vec_id: (r.class_id, r.n_links, r.group_id) for r in rabitq.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == 308 and {got[i] for i in range(300)} == {(0, 0, 0)} and got[401] == (400, 0, 400)
    assert all(got[i] == (i, 0, i) for i in (402, 403, 404, 405)) and got[407][2] == got[406][2] == 0
    assert rabitq.groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rabitq_anisotropic_recall(spark):
    x = vectors(6, 400, 64) + 1.5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= rabitq.THRESHOLD, 1)))}
    rows = rabitq.near_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    got = {(r.id_a, r.id_b) for r in rows}
    assert got <= want and len(got) >= 0.95 * len(want) > 0


@pytest.mark.parametrize("block", [7, 40])
def test_large_buckets_in_blocks(spark, block, monkeypatch):
    from pyspark.sql import functions as F

    from skein.llm.common import in_blocks, stored

    rows = spark.createDataFrame([(i % 2 if i < 120 else 5 + i, i) for i in range(150)], "key long, node long")
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "sizes")
    met: dict[int, set[int]] = {}
    for r in in_blocks(rows, "key", "node", block, sizes).collect():
        met.setdefault(r.key, set()).add(r.node)
    together = {(a, b) for s in met.values() for a in s for b in s}
    assert together == {(a, b) for a in range(150) for b in range(150) if a == b or (a < 120 and b < 120 and a % 2 == b % 2)}
    assert max(map(len, met.values())) <= 4 * block
    x = vectors(3, 200, 64) * 0.05 + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, rabitq.near_pairs(df).collect()))
    monkeypatch.setattr(rabitq, "BLOCK", block)
    assert sorted(map(tuple, rabitq.near_pairs(df).collect())) == whole


def test_texts_beyond_a_slice(spark):
    """A text of 5 MB, more than is handled at once, and its copy: every operator reads them whole."""
    r = np.random.default_rng(12)
    v = np.array([f"the word{i} of" for i in range(3000)])
    t = " ".join(v[r.integers(0, 3000, 350_000)])
    docs = spark.createDataFrame([(1, t, "en"), (2, t + " END", "en"), (3, "the short text of all", "en")], "doc_id long, text string, lang string").repartition(3)
    n = len(t.split())
    assert {x.doc_id: x.group_id for x in spotsigs.groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x.doc_id: x.group_id for x in simhash.groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x.doc_id: (x.n_words, x.cut_words) for x in suffix.dedup(docs).select("doc_id", "n_words", "cut_words").collect()} == {1: (n, 0), 2: (n + 1, n), 3: (5, 0)}
    encoded = pieces.encode(docs, check=True)
    size = {x.doc_id: x.n_tokens for x in encoded.where("round_trip").select("doc_id", "n_tokens").collect()}
    assert len(size) == 3 and size[1] < size[2]
    assert {x.doc_id: x.s for x in packing.pack(docs).selectExpr("explode(arrays_zip(doc_ids, tokens)) z", "truncated").selectExpr("z.doc_ids doc_id", "z.tokens t").groupBy("doc_id").sum("t").withColumnRenamed("sum(t)", "s").collect()} == size
    model = langid.fit({"en": [t[:50_000]], "fr": ["le chat et le chien"]})
    assert {x.doc_id: (x.accepted, x.lang) for x in langid.identify(docs.where("doc_id < 3"), model).collect()} == {1: (True, "en"), 2: (True, "en")}
    bad, good = toxic_world(7)
    rows = {x.doc_id: x.windows for x in toxicity.classify(docs, toxicity.fit(bad[:100], good[:200])).collect()}
    assert rows == {1: -(-n // 16), 2: -(-(n + 1) // 16), 3: 1}


def test_fixed_randomness():
    assert zlib.crc32(simhash.band_positions().astype(np.int16).tobytes()) == zlib.crc32(simhash.band_positions().astype(np.int16).tobytes())
    q = rabitq.rotation(64)
    assert np.allclose(q @ q.T, np.eye(64))
