"""The ten operators and the pipeline against brute force, with nulls, blanks, long texts, ties and repeats."""

import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, fingerprints, grouping_sort, html_extract, jaccard_join, language_id, mixing, packing, quality, stages, suffix_dedup, vector_search, warc
from tessera.llm.common import shingle_hashes
from tessera.llm.components import components
from tessera.llm.common import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, blanks, nulls and a long text."""
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "ka lo mi re tu se an".split() for b in "na ter ion ble ing".split()]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    passage, base = text(30), text(90)
    rows = []
    for i in range(n):
        t = text(r.randint(1, 80))
        if i % 5 == 0:
            w = base.split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif i % 7 == 0:
            t = text(12) + "\n" + passage + "\n" + text(9)
        rows.append((i * 3, t, r.choice(["en", "de"]), r.choice(["s1", "s2", None]), len(t), "x", "y"))
    rows += [(500, None, None, None, None, None, None), (501, "", "en", "s1", 0, "", ""), (502, " \n\t", "en", "s1", 3, "", ""), (503, text(6000), "en", "s2", 1, "", ""), (504, base, "de", "s1", 1, "", ""), (505, base, "de", "s1", 1, "", "")]
    rows += [rows[0], rows[7], (None, passage, "en", "s1", 1, "", ""), (600, "one", "en", "s9", 3, "", ""), (601, "two words", "en", "s9", 9, "", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_codewords_are_distinct():
    for n in (1, 2, 4, 5, 9, 20):
        m = language_id.codewords(n)
        assert len({tuple(x) for x in m}) == n or n == 1
    m = language_id.codewords(9)
    assert min((m[i] != m[j]).sum() for i in range(9) for j in range(i)) >= 5


def test_language_id(spark, empty):
    r = random.Random(4)
    make = {"xx": "schlung keit ung der und ein".split(), "yy": "tion eau elle les dans que".split(), "zz": "ción mente ado los para del".split()}
    rows = [(i, " ".join(r.choice(make[lang]) for _ in range(30)), lang, "s", 1, "a", "b") for i in range(150) for lang in [r.choice(list(make))]]
    df = spark.createDataFrame(rows + [(900, None, "xx", "s", 1, "", ""), (901, "12 !?", None, "s", 1, "", "")], DOCS)
    kept = language_id.held_out(F.col("doc_id"))
    model = language_id.train(spark, df.filter(~kept))
    out = language_id.identify(spark, df, model)
    got = {x.doc_id: x for x in out.collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert held and all(got[x[0]].lang_pred == x[2] for x in held)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert all(0 <= x.score <= 1 for x in got.values()) and out.columns.count("score") == 1
    none = language_id.train(spark, empty)
    assert none.langs == [] and {x.lang_pred for x in language_id.identify(spark, df, none).collect()} == {"und"}
    assert language_id.identify(spark, empty, model).count() == 0


def test_every_language_is_learned(spark):
    r = random.Random(5)
    make = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(12)}
    rows = [(100 * k + i, " ".join(r.choice(make[lang]) for _ in range(30)), lang, "s", 1, "a", "b") for k, lang in enumerate(make) for i in range(10 + k)]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.train(spark, df, per_language=40, languages=3)
    assert model.langs == sorted(make)
    assert all(x.lang_pred == x.lang for x in language_id.identify(spark, df, model).collect())


# 2


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets[d] = shingles(t, k)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, docs, k, percent):
    got = jaccard_join.jaccard_components(spark, docs, k, percent).collect()
    want = brute_components([(x[0], x[1]) for x in corpus()], k, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == want
    assert len(got) == len(corpus())


def test_jaccard_large_near_group(spark):
    """Copies with many different edits: hubs don't reach them all, the last order must."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"n{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows, 3, 90)


def test_spanning_links_join_what_links_join():
    r = random.Random(8)
    for percent in (60, 80, 90):
        base = [r.getrandbits(63) for _ in range(60)]
        sets = []
        for _ in range(50):
            own = set(r.sample(base, r.randint(40, 60))) | {r.getrandbits(63) for _ in range(r.randint(0, 8))}
            sets.append(np.array(sorted(own), np.int64))
        root = np.array([r.randrange(30) for _ in sets])

        def joined(pairs):
            label = root.tolist()
            for x, y in pairs:
                label = [label[x] if v == label[y] else v for v in label]
            return [label.index(v) for v in label]

        every = [(x, y) for x in range(50) for y in range(x) if 100 * len(set(sets[x]) & set(sets[y])) >= percent * len(set(sets[x]) | set(sets[y]))]
        got = jaccard_join.spanning_links(sets, root, percent)
        assert joined(got) == joined(every) and set(got) <= {p for x, y in every for p in ((x, y), (y, x))} and len(got) < 50


def test_spanning_links_of_a_chain_in_any_order():
    """Only neighbours of the chain are linked; the largest set changes while it is joined."""
    chain = [np.arange(i, i + 20, dtype=np.int64) for i in range(5)]
    for order in itertools.permutations(range(5)):
        got = jaccard_join.spanning_links([chain[i] for i in order], np.arange(5), 90)
        assert sorted(tuple(sorted((order[x], order[y]))) for x, y in got) == [(i, i + 1) for i in range(4)]


@pytest.mark.parametrize("unit", [0, 1 << 20])
def test_jaccard_by_units(spark, docs, unit, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    got = jaccard_join.jaccard_components(spark, docs, 3, 80).collect()
    want = brute_components([(x[0], x[1]) for x in corpus()], 3, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == want


def test_words_of_periodic_letters_differ():
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 16:
            a, b = word, word.translate(str.maketrans("ab", "ba"))
            assert shingle_hashes(a, 3)[0] != shingle_hashes(b, 3)[0]


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    w, v = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, w), (2, w), (2, v), (2, v), (None, w), (None, w), (None, v), (3, ""), (3, ""), (4, None), (1, "s t u v w x y")]
    out = stages.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = [(1, w), (1, "s t u v w x y"), (2, v), (3, ""), (3, ""), (4, None), (None, v), (None, w), (None, w)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_jaccard_empty(spark, empty):
    assert jaccard_join.jaccard_components(spark, empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (9, 8)], "a long, b long")
    got = {r.node: r.root for r in components(Tables(spark, "t"), edges, "c").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_hashes_of_long_texts_agree():
    t = " ".join(f"word{i % 977}" for i in range(600_000))
    a = shingle_hashes(t, 3)
    assert len(a) == len(shingles(t, 3))


# 3


def test_html_blocks_decode_and_collapse():
    page = "<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>one\n  two<br>three <b>x</b>&eacute;</p><script>var a='<p>no</p>'</script><p>last</article><!-- c --></body>"
    assert [t for _, t, _ in html_extract.blocks(page)] == ["Home", "A & B", "one two three xé", "last"]
    assert html_extract.blocks("") == [] and html_extract.blocks("a < b") [0][1] == "a < b"
    assert html_extract.blocks("<p>x<a href='")[0][1] == "x"


@pytest.mark.parametrize("between", ["<script>if(a<b){x=1}</script>", "<svg class=x />", "<style>b:before{content:'<x'}</style>", "<script>'</p><p>no'</script >", "<iframe src=x><p>no</iframe>", "<!-- <p>no -->"])
def test_nothing_is_lost_beside_raw_elements(between):
    assert html_extract.blocks(f"<p>one</p>{between}<p>two</p>") == [(("p",), "one", 0.0), (("p",), "two", 0.0)]


def test_controls_are_blocks_of_their_own():
    got = [(p[-1], t) for p, t, _ in html_extract.blocks("<title>a &amp; <b></title><p>one<button>go<p>two<select><option>x<option>y</select> three<textarea><i></textarea>")]
    assert got == [("title", "a & <b>"), ("p", "one"), ("button", "go"), ("p", "two"), ("option", "x"), ("option", "y"), ("p", "three"), ("textarea", "<i>")]


def test_deep_nesting_keeps_all_text():
    got = html_extract.blocks("".join(f"<div>a{i}" for i in range(3000)) + "</div>" * 3000)
    assert [t for _, t, _ in got] == [f"a{i}" for i in range(3000)] and max(len(p) for p, _, _ in got) == html_extract.DEEPEST


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_extract.extract(spark, pages).select("html", "text").collect()
    for x in got:
        article = re.search(r"<article[^>]*>(.*)</article>", x.html, re.S)[1]
        assert x.text == "\n".join(t for _, t, _ in html_extract.blocks(article))
    assert len(got) == 250



def test_html_words_of_the_whole_block():
    long = ("body",), " ".join(["same"] * 2000 + ["reply", "comment"]) + ".", 0.0
    _, _, words, _, _ = html_extract.vectors([long])
    assert sorted(words) == sorted(html_extract._slot(w, html_extract.WORDS) for w in ("same", "reply", "comment"))


def test_html_labels(spark):
    model = html_extract.trained()
    r = np.random.default_rng(77)
    right = total = 0
    for _ in range(60):
        page, want = html_extract.made_page(r)
        got = html_extract.blocks(page)
        assert [t for _, t, _ in got] == [t for t, _ in want]
        marks = model.label([html_extract.vectors(got)])[0]
        right += sum(bool(m) == y for m, (_, y) in zip(marks, want))
        total += len(want)
    assert right / total > 0.97
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here.</h1><p>Some text of it.</p><p>More of the text.</p></article><footer>&copy; All rights reserved.</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "v", "", "t"), (1, "u", page, "t")], "page_id long, url string, html string, text string")
    got = sorted((x.page_id, x.text, x.n_chars) for x in html_extract.extract(spark, df, model).collect())
    main = "Title here.\nSome text of it.\nMore of the text."
    assert got == [(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0)]
    assert html_extract.extract(spark, df.limit(0), model).count() == 0


# 4


def brute_repeats(rows, length=50):
    own = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            g = b[i : i + length]
            own[g] = min(d, own.get(g, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if own[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append((d if d is not None else -1, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out)


def test_suffix_order_matches_sorting():
    r = random.Random(2)
    for _ in range(300):
        ss = [bytes(r.choice(b"ab\x00c"[: r.randint(1, 4)]) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 6))]
        text, at, want = b"".join(ss), 0, {}
        for s in ss:
            want.update({at + i: s[i:] for i in range(len(s))})
            at += len(s)
        got = grouping_sort.suffix_order(np.frombuffer(text, np.uint8), np.array([len(s) for s in ss], np.int64), np.zeros(len(ss), np.int64)).tolist()
        assert sorted(got) == sorted(want) and [want[i] for i in got] == sorted(want.values())
        assert len(text) == len(got)


def test_suffix_orders_of_sets():
    r = random.Random(5)
    for _ in range(200):
        ss = [bytes(r.choice(b"abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 9))]
        sets = np.sort(np.array([r.randrange(3) for _ in ss]))
        data, sizes = np.frombuffer(b"".join(ss), np.uint8), np.array([len(s) for s in ss])
        order, run = grouping_sort.equal_runs(data, sizes, sets, 8)
        of, raw, seen = np.repeat(sets, sizes), data.tobytes(), {}
        for i, x in zip(order.tolist(), run.tolist(), strict=True):
            seen.setdefault(x, set()).add((int(of[i]), raw[i : i + 8]))
        assert len(order) == sum(max(0, len(s) - 7) for s in ss)
        assert all(len(v) == 1 for v in seen.values()) and len(set.union(set(), *seen.values())) == len(seen)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, docs, small, monkeypatch):
    if small:  # several blocks, slices of a set, and frequent windows
        for name, x in (("SPLIT", 1), ("FLUSH", 3000), ("SORT", 500), ("CUT", 16), ("LONGEST", 40)):
            monkeypatch.setattr(suffix_dedup, name, x)
    out = suffix_dedup.repeated_bytes(spark, docs).select(F.coalesce("row.doc_id", F.lit(-1)).alias("d"), "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect())) == brute_repeats([(x[0], x[1]) for x in corpus()])


def test_suffix_dedup_periodic_and_empty(spark, empty):
    rows = [(1, "a" * 200), (2, "a" * 120), (3, "ab" * 80), (4, "b" + "ab" * 60), (5, "é" * 60), (6, "xé" + "é" * 40)]
    out = suffix_dedup.repeated_bytes(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()))
    assert got == brute_repeats(rows)
    assert suffix_dedup.repeated_bytes(spark, empty).count() == 0


def test_small_sets_are_not_sorted_beside_a_rich_one(monkeypatch):
    """A sort takes as many steps as its richest set has words; the marks are those of any slicing."""
    r = np.random.default_rng(3)
    sizes = np.repeat([60] * 1500 + [150_000] + [60] * 1500, 2)
    data = np.concatenate([np.tile(r.integers(0, 256, n).astype(np.uint8), 2) for n in sizes[::2]])
    doc = np.arange(len(sizes))
    none = np.zeros(len(sizes), np.int64)
    s = suffix_dedup.Strings(data, np.cumsum(sizes) - sizes, sizes, (doc // 2).astype(np.uint64), doc, none, none)
    real, seen = suffix_dedup.equal_runs, []

    def noted(data, sizes, sets, length):
        seen.append(sizes.max())
        assert sizes.min() == sizes.max()
        return real(data, sizes, sets, length)

    monkeypatch.setattr(suffix_dedup, "equal_runs", noted)
    runs = suffix_dedup.Runs()
    left = suffix_dedup.judge(s, 50, runs)
    got = {(d, tuple(np.frombuffer(x, "<i8"))) for d, _, x in runs.rows()}
    assert got == {(d, (0, n - 49)) for d, n in zip(doc.tolist(), sizes.tolist(), strict=True) if d % 2}
    assert sorted(left.doc) == doc[::2].tolist() and set(seen) == {60, 150_000}


def test_least_hashes_do_not_depend_on_tiles(monkeypatch):
    data = np.random.default_rng(4).integers(0, 4, 3000).astype(np.uint8)
    for length, k in ((50, 16), (50, 40), (16, 8)):
        for n in (length - 1, length, 700, 3000):
            want = suffix_dedup._least(data[:n], length, k)
            one = [suffix_dedup._least(data[a : a + length], length, k)[0] for a in range(n - length + 1)]
            assert want.tolist() == one
            for tile in (1, 64, 651):
                with monkeypatch.context() as m:
                    m.setattr(suffix_dedup, "TILE", tile)
                    assert suffix_dedup._least(data[:n], length, k).tolist() == one


# 5


def test_weak_labels_and_scorer(spark, empty):
    r = random.Random(3)
    words = [f"{a}{b}" for a in "the of and in on ra wa le".split() for b in "ing er tion ly ble nd st".split()]
    good = [" ".join(r.choice(words) for _ in range(r.randint(20, 80))).capitalize() + ". And so it is." for _ in range(160)]
    loud = [" ".join(r.choice(words).upper() + "!!" for _ in range(40)) for _ in range(20)]
    junk = [" ".join(r.choice(words) + r.choice(["###", "$$$", "&&&"]) for _ in range(40)) for _ in range(20)]
    rows = [(i, t, "en", "s", 1, "q", "z") for i, t in enumerate(good + loud + junk + ["You idiot, moron and clown of a thing."])] + [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    model = quality.train(spark, df)
    assert model.weak.share[0] > 0.6, model.weak
    got = {x.doc_id: x for x in quality.classify(spark, df, model).select('row.doc_id', 'keep', 'abuse_words', 'score').collect()}
    keep = [got[i].keep for i in range(len(rows) - 2)]
    assert sum(keep[:160]) >= 158 and sum(keep[160:]) <= 2
    assert not got[900].keep and not got[901].keep and got[200].abuse_words == 3
    assert quality.classify(spark, empty).count() == 0


def test_abuse_in_other_languages_and_marks():
    found = {t: quality.measure(t).abuse for t in ('He said "IDIOT"!!', "(moron) clown-like", "idiotic clowns", "Du ARSCHLÖCHER, du Trottel!", "espèce d'IMBE\u0301CILE.", "¡Estúpido, gilipollas!", None, "")}
    assert list(found.values()) == [1, 2, 0, 2, 1, 2, 0, 0]


# 6


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = stages.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = packing.pack(spark, docs, path, capacity=64).toPandas()
    want = []
    for x in corpus():
        ids = [*tok.encode(x[1] or "", add_special_tokens=False).ids, 0]
        want += [(-1 if x[0] is None else x[0], k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 64 + 1
    assert packing.pack(spark, empty, path).count() == 0


def test_words_are_tokenized_alone():
    from tokenizers import Tokenizer

    path = stages.tokenizer_path()
    tok, known = Tokenizer.from_file(path), packing._Words(path)
    r = random.Random(8)
    texts = ["it's THE'S don't", "a<|endoftext|>b", "Σς ΑΣ İ ﬁ", "\x1c a\x85b\xa0c", "１² ½ _x__", ""] + ["".join(r.choice("aA'é1!_<|> \n\tßΣı日&-") for _ in range(30)) for _ in range(400)]
    for t in texts:
        p = known.pieces(t)
        known.learn(p)
        assert known.ids(p) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_plan_holds_the_histogram():
    r = np.random.default_rng(0)
    for _ in range(20):
        hist = r.integers(0, 40, 129) * (r.random(129) < 0.4)
        hist[0] = 0
        used = np.zeros(129, int)
        for pattern, times in packing.plan(hist):
            assert sum(pattern) <= 128
            np.add.at(used, list(pattern), times)
        assert (used == hist).all()


def test_pieces_of_one_length_share_new_sequences():
    for cap in (128, 2048):
        for length in (1, 3, 20, 63, 64, 65, 100, 128):
            for n in (1, 7, 5000):
                hist = np.zeros(cap + 1, np.int64)
                hist[length] = n
                planned = packing.plan(hist)
                assert sum(len(pattern) * times for pattern, times in planned) == n
                assert sum(times for _, times in planned) == -(-n // (cap // length)), (cap, length, n)


def test_tokenizers_that_keep_capitals_get_whole_texts():
    for name, whole in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        words = packing._Words(stages.tokenizer_path(name))
        assert words.whole == whole
        for t in ("", "Él niño, Hello  world's\n end", "a" * 5000, "\u200b<|x|> 12,5"):
            assert words.of(t) == words.encode(t)


def test_words_stay_known_through_long_vocabularies():
    """300,000 other words between two uses of a word do not make it be tokenized again; ids are those of whole texts."""
    r = random.Random(12)
    texts = [" ".join("".join(r.choice("abeéß") for _ in range(r.randint(1, 9))) + r.choice(["", ",", "!!"]) for _ in range(200)) for _ in range(20)]
    words = packing._Words(stages.tokenizer_path())
    tok, asked = words.tok, []

    class Counting:
        def encode(self, text, **how):
            asked.extend(text.split(" "))
            return tok.encode(text, **how)

    words.tok = Counting()
    for again in range(2):
        for t in texts:
            assert words.of(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            words.age()
        for half in range(2):
            words.new.update((f"{again}.{half}.{i}", b"") for i in range(150_000))
            words.age()
    assert len(asked) == len(set(asked)) > 1000


# 7


def test_vector_search(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 40)
    monkeypatch.setattr(vector_search, "QUERIES", 3)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 0.3, 8))], 1) for i in range(150)]
    rows += [(i, [0.0] * 8, 1) for i in range(150, 200)]  # ties
    bad = [(200, None, 1), (220, [1.0, None] + [0.0] * 6, 1), (240, [float("nan")] * 8, 1), (260, [float("inf")] * 8, 1), (None, [0.1] * 8, 1), rows[3]]
    got = vector_search.top_inner_products(spark, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")).collect()
    ids, m = np.array([x[0] for x in rows]), np.floor(64 * np.array([x[1] for x in rows])).astype(int)
    want = []
    for i, q in zip(ids, m):
        if i % 20 == 0:
            order = [j for j in np.lexsort((ids, -(m @ q))) if ids[j] != i][:20]
            want += [(int(i), n + 1, int(ids[j]), int(m[j] @ q)) for n, j in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert vector_search.top_inner_products(spark, spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")).count() == 0
    assert vector_search.top_inner_products(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    v, q = r.integers(-40, 40, (300, 16)), r.integers(-40, 40, (20, 16))
    low, high = vector_search.Approximation(v).bounds(q)
    exact = q @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < (exact.max() - exact.min())


# 8


def test_fingerprints(spark, docs, empty):
    rows = sorted(((x[0] if x[0] is not None else -1, x[1] or "") for x in corpus()), key=lambda x: x)
    f = fingerprints.fingerprints(spark, docs)
    got = f.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "n_chars", F.sha2("edited_text", 256).alias("e"), fingerprints.as_text(F.col("sketch")).alias("s"), fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near"), fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("next"), fingerprints.distinct_shingles(F.col("sketch")).alias("n")).collect()
    want, near = [], {}
    for i, (d, t) in enumerate(rows):
        n = len(t) // 4
        e = t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
        a, b = shingles(t, 5), shingles(e, 5)
        near[want[-1]] = (len(a & b) / len(a | b) if a | b else 1.0, len(a))
    assert sorted((x.d, x.n_chars, x.e) for x in got) == sorted(want)
    for x in got:
        true, n = near[x.d, x.n_chars, x.e]
        # with at most K shingles in the union the estimate is exact
        assert abs(x.near - true) < (0.2 if n > 60 else 1e-9) and abs(x.n - n) <= 0.4 * n
    assert len({x.s for x in got if x.d in (504, 505)}) == 1
    assert fingerprints.fingerprints(spark, empty).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 300])
def test_next_row_over_ranges(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        ids = [None, *range(0, 400, 7), 10**12, 5]
        df = spark.createDataFrame([(i, f"t{i}", "z") for i in ids], "k long, t string, other string")
        got = {r.t: r.next_t for r in fingerprints.with_next(spark, df, "k", ["t"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = [f"t{i}" for i in sorted(ids, key=lambda i: -1 if i is None else i)]
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_sketches_merge(spark):
    r = random.Random(6)
    parts = [" ".join(f"w{r.randrange(4000)}" for _ in range(700)) for _ in range(4)]
    df = spark.createDataFrame([("k", p) for p in parts] + [("n", "")], "k string, t string").withColumn("sketch", fingerprints.shingle_sketch(F.col("t")))
    got = {x.k: x.sketch for x in fingerprints.merge_parts(df, "k").collect()}
    every = sorted({h for x in df.collect() for h in x.sketch})[: fingerprints.K]
    assert got["k"] == every and got["n"] == []
    c = df.limit(1).crossJoin(spark.createDataFrame([(got["k"],)], "m array<long>")).select(fingerprints.containment(F.col("sketch"), F.col("m")).alias("c")).first().c
    assert c > 0.7


# 9


def test_mixing(spark, docs, empty):
    out = mixing.mixed(spark, docs.select("doc_id", "source", "text", F.lit(1).alias("target"))).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    rows = corpus()
    sizes = {}
    for x in rows:
        sizes[x[3]] = sizes.get(x[3], 0) + len(WORD.findall(x[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, target, free, left = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        for s in over or list(free):
            target[s] = 3 * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        free -= set(over or free)
    assert len(out) == len(rows)
    taken = {}
    for x in out:
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6 and x.taken <= 3 * x.size and x.copies * x.size == x.taken
        taken[x.source] = taken.get(x.source, 0) + x.taken
    largest = {s: max([len(WORD.findall(x[1] or "")) for x in rows if x[3] == s]) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in sizes)
    again = mixing.mixed(spark, docs.repartition(5).select("doc_id", "source", "text")).select("row.doc_id", "size", "taken").collect()
    assert sorted((str(x.doc_id), x.size, x.taken) for x in again) == sorted((str(x.doc_id), x.size, x.taken) for x in out)
    assert mixing.mixed(spark, empty).count() == 0


def test_mixing_of_two_constraints(spark):
    r = random.Random(11)
    rows = [(i, "w " * r.randint(1, 30), r.choice(["a", "b", None]), r.choice(["x", "y"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    total = sum(len(t.split()) for _, t, _, _ in rows)
    goal = {"x": total * 0.3, "y": total * 0.7}
    out = mixing.mixed(spark, df, others={"lang": (F.col("lang"), spark.createDataFrame(list(goal.items()), "value string, target double"))}).collect()
    for value, want in goal.items():
        assert abs(sum(x.taken for x in out if x.row.lang == value) - want) < 100
    for x in out:
        got = sum(y.taken for y in out if y.row.source == x.row.source)
        assert abs(got - x.target) < 100
        break
    with pytest.raises(ValueError):
        mixing.SWEEPS, before = 5, mixing.SWEEPS
        try:
            mixing.mixed(spark, df, others={"lang": (F.col("lang"), spark.createDataFrame([("x", 1.0)], "value string, target double"))}).collect()
        finally:
            mixing.SWEEPS = before


CLASHING = ["base", "before", "extra", "tie", "salt", "r", "row", "size", "target", "rate", "copies", "taken", "posterior", "score", "keep", "spans", "kept", "n_bytes", "marks", "rk", "loose", "again", "gone", "text_key", "component", "left", "id", "p", "y", "tilt"]


def test_stages_keep_columns_that_clash(spark):
    """Columns named like anything inside or like a result go through; so do repeated ids with other texts and null ids."""
    rows = [x for x in corpus(n=20)]
    d = spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for stage in (stages.quality, stages.near_duplicates, stages.repeated_passages, stages.mixture):
        out = stage(spark, d, "")
        assert out.columns == d.columns
        got = out.collect()
        assert got and all(x[c] == (None if x.doc_id is None else f"{c}{x.doc_id}") for x in got for c in CLASHING)


# 10


def test_warc_roundtrip(spark):
    r = random.Random(1)
    page = lambda: "<p>" + "".join(r.choice("abc dé\n") for _ in range(200)) + "</p>"
    rows = [(i, f"http://x/{i}", page()) for i in range(30)]
    rows += [(100 + i, "u", rows[2][2]) for i in range(5)] + [(200, None, None), (201, "u\r\nv", ""), (202, "u", "\r\n\r\nWARC/1.1"), (None, "n", rows[3][2]), (203, "u", "z" * 300_000), rows[4]]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, payload int")
    archives = warc.write_archives(spark, df)
    got = warc.read_archives(spark, archives).collect()
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(p, best.get(h or "", -1))
    want = []
    for p, _, h in rows:
        b, keep = (h or "").encode(), best.get(h or "")
        other = keep if p is not None and keep != p else None
        want.append((str(p), "revisit" if other is not None else "response", len(b), warc.digest(b), str(other), None if other is not None else b))
    key = lambda x: tuple(map(str, x))
    assert sorted(((str(x.page_id), x.record_type, x.payload_bytes, x.payload_digest, str(x.refers_to), None if x.payload is None else bytes(x.payload)) for x in got), key=key) == sorted(want, key=key)
    first = bytes(archives.first().data)
    heads = [warc.parse_record(x) for x in warc.records(first)]
    assert heads[0][0]["WARC-Type"] == "warcinfo" and all(h["Content-Type"] == "application/http;msgtype=response" and b.startswith(b"HTTP/1.1 200 OK\r\n") for h, b in heads[1:])
    ids = {h["WARC-Record-ID"]: h["WARC-Type"] for h, _ in heads}
    assert all(ids[h["WARC-Refers-To"]] == "response" for h, _ in heads if h["WARC-Type"] == "revisit")
    assert first[:4] == b"\x5d\x2a\x4d\x18" and len(first) < sum(len(x[2] or "") for x in rows)
    with pytest.raises(Exception):
        list(warc.records(b"nothing here"))
    assert warc.read_archives(spark, warc.write_archives(spark, df.limit(0))).count() == 0


# pipeline


def test_saved_tables_free_the_driver(spark, monkeypatch):
    """What steps leave in the driver goes every few tables, however much its heap could hold."""
    monkeypatch.setattr(common, "SAVES", 2, raising=False)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def whole():
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    t, before = Tables(spark, "t"), whole()
    for i in range(4):
        t.save(spark.range(3), f"x{i}")
    assert whole() >= before + 2
    assert common.trim_native(spark) or sys.platform != "linux"


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    near = stages.near_duplicates(spark, d, "")
    want = brute_components([(x[0], x[1]) for x in corpus()], 5, 80)
    assert {x.doc_id for x in near.collect() if x.doc_id is not None} == {i for i, (_, c) in want.items() if i == c}
    cut = stages.repeated_passages(spark, near, "")
    assert cut.columns == d.columns
    mix = stages.mixture(spark, cut, "")
    assert mix.columns == d.columns
    kept = {x.doc_id: x.text for x in cut.collect()}
    assert all(kept[x.doc_id] == x.text for x in mix.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(*d.columns), "").count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.filter("n > 2048 or n <> end").count() == 0 and out.count() > 50
