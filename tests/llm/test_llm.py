"""Each operator against a plain version or a library, with nulls, ties, copies, empty tables and clashing names."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute

from lectern.llm import components as CC
from lectern.llm import decontaminate as D
from lectern.llm import html_text as H
from lectern.llm import jaccard_join as J
from lectern.llm import knn_join as K
from lectern.llm import language_id as G
from lectern.llm import mixing as M
from lectern.llm import substring_dedup as S
from lectern.llm import token_counts as T
from lectern.llm import toxicity as X
from lectern.llm import url_filter as U

DOCS = "doc_id long, text string"


def texts(seed, n=120, words="abcdefgh", longest=40):
    """Short texts of few words with copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = [rng.choice("klmnop") for _ in range(12)]
    out = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, longest))]
        if rng.random() < 0.3:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        out.append(w)
        for _ in range(rng.choice([0, 0, 1, 4])):
            c = list(w)
            if c and rng.random() < 0.6:
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(c)
    gaps = [" ", "\n", "\t ", "  "]
    return [(i, rng.choice(gaps).join(w)) for i, w in enumerate(out)]


# ---- substring dedup


@pytest.mark.parametrize("seed,window,prefixes,limit", [(1, 6, (3,), 20_000), (2, 6, (3,), 2), (3, 10, (10,), 5), (4, 4, (1,), 3), (5, 6, (2, 4, 5), 40), (6, 5, (1, 2, 5), 12)])
def test_repeats_equal_brute_force(spark, seed, window, prefixes, limit):
    rows = texts(seed)
    got = S.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5), window=window, prefixes=prefixes, group_windows=limit)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == brute.removed(rows, window)


def test_repeats_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(None, long, "a"), (3, long, "b"), (3, long, "b"), (1, None, None), (2, "", "c"), (9, long + " x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d string").withColumn("n_words", F.lit("old")).withColumn("_spans", F.lit(1))
    got = S.remove_repeats(df, window=50)
    assert got.columns == ["doc_id", "text", "_d", "_spans", "n_words", "n_removed", "kept_text", "kept_sha256"]
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in got.collect()) == [(-1, 5000, 5000), (1, 0, 0), (2, 0, 0), (3, 5000, 0), (3, 5000, 0), (9, 5001, 5000)]
    assert S.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_subtrees_equal_brute_force(seed):
    """Strings of window codes: what earlier documents share, and the maximal repeats."""
    rng = random.Random(seed)
    strings = [(g, d, [rng.choice("ab" if seed % 2 else "abcdef") for _ in range(rng.randint(1, 12))]) for g in (3, 5) for d in range(6)]
    flat = [(g, d, p, ord(c)) for g, d, x in strings for p, c in enumerate(x)]
    rng.shuffle(flat)
    g, d, p, c = (np.array(x, dtype=np.int64) for x in zip(*flat, strict=True))
    tree = S.Subtrees(g, d, g * 100 + d, p, c)
    deep = dict(zip(zip(tree.text[tree.sa].tolist(), tree.place[tree.sa].tolist(), strict=True), tree.earlier().tolist(), strict=True))
    assert {k: v for k, v in deep.items() if v} == brute.earlier(strings)
    size, places, first = tree.repeats()
    got = sorted(zip(size.tolist(), places.tolist(), tree.text[first].tolist(), tree.place[first].tolist(), strict=True))
    assert got == brute.repeats(strings)


def test_a_long_shared_passage_is_one_maximal_repeat(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(4, "a b " + passage + " c"), (2, "d " + passage), (9, passage + " e f"), (7, "g " + " ".join(passage.split()[:60]) + " h")]
    df = spark.createDataFrame(rows, DOCS)
    got = S.maximal_repeats(df, window=50, prefixes=(16,)).collect()
    # a run of windows with one least prefix follows another: together they cover the passage from its first word to its last
    assert {r["_d"] for r in got} == {2} and min(r["lo"] for r in got) == 1 and max(r["lo"] + r["words"] for r in got) == 81
    assert {r["places"] for r in got} <= {3, 4} and any(r["words"] > 50 for r in got)
    single = S.maximal_repeats(df, window=50, prefixes=(16, 32), group_windows=2).collect()
    assert {r["words"] for r in single} <= {50, 51} and {r["_d"] for r in single} <= {2, 4, 7, 9}  # alike runs count once
    long = S.maximal_repeats(spark.createDataFrame([(1, "x " * 300), (2, "x " * 200)], DOCS), window=50).collect()
    assert max(r["words"] for r in long) == 299
    assert S.maximal_repeats(df.limit(0)).count() == 0


def test_ids_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "b c")], "doc_id string, text string")
    with pytest.raises(TypeError):
        S.remove_repeats(df)
    with pytest.raises(TypeError):
        J.jaccard_components(df)


def test_kept_text_has_what_is_left(spark):
    a = " ".join(f"w{i}" for i in range(60))
    got = S.remove_repeats(spark.createDataFrame([(1, a), (2, "start " + a + " end")], DOCS)).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in got] == [a, "start end"]


# ---- n-gram join


@pytest.mark.parametrize("seed,n,num", [(1, 5, 80), (2, 2, 80), (3, 2, 50), (4, 3, 90)])
def test_links_equal_brute_force(spark, seed, n, num):
    rows = texts(seed)
    want, links = brute.linked(rows, n, num, 100)
    got = J.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5), n=n, threshold=(num, 100), often=3)
    assert links and {r["_d"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    want, _ = brute.linked(rows, 5, 80, 100)
    got = J.jaccard_components(spark.createDataFrame(rows, DOCS), often=5, reaches=(1, 4))
    assert {r["_d"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_long_lists_in_parts_lose_no_link(spark):
    rows = texts(11, n=200, words="abcd", longest=14)
    want, _ = brute.linked(rows, 2, 60, 100)
    for reaches in ((), (2,)):
        got = J.jaccard_components(spark.createDataFrame(rows, DOCS), n=2, threshold=(60, 100), often=3, reaches=reaches, list_rows=3)
        assert {r["_d"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_links_of_odd_rows(spark):
    long = " ".join(f"W{i}" for i in range(9000))
    rows = [(None, "a b c"), (5, "A  b C"), (5, "A  b C"), (6, None), (7, ""), (8, " \n"), (None, None), (10, long), (11, long.lower())]
    got = J.jaccard_components(spark.createDataFrame(rows, DOCS).withColumn("cid", F.lit("x")))
    assert sorted((r["_d"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got.collect()) == [(-1, 0, -1), (-1, 1, 5), (5, 1, 5), (5, 1, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (10, 8996, 10), (11, 8996, 10)]
    assert J.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_boundary_follows_cost():
    assert J.boundary({}, 1.0, (80, 100)) == 0
    assert J.boundary({4: 100, 5: 100}, 50.0, (80, 100)) >= 5


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(100, 99), (7, 7)]
    got = {r["node"]: r["root"] for r in CC.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 99}
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert CC.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    up = list(range(400))
    for _ in range(400):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in CC.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: r for i, r in enumerate(up) if r != i}


# ---- decontamination


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_hits_equal_brute_force(spark, block_words):
    rows = texts(7) + [(9000, None), (9001, ""), (9002, "K, L! m-N o.p k/l")]
    items = [(i, t) for i, t in texts(8, 12)] + [(500, "k l m"), (501, None), (502, "!!"), (503, "k l m n o p k l m n o p")]
    got = D.contamination(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"), window=6, block_words=block_words)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.hits(rows, items, 6)


def test_items_without_an_id_and_long_items(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a " + item + " b"), (2, "n o p"), (2, "n o p"), (3, None)], DOCS)
    bench = spark.createDataFrame([(None, "N o P"), ("None", "w38 w39 zz"), ("x", item), ("x", item)], "item_id string, text string")
    for block_words in (500_000, 12):
        got = D.contamination(docs, bench, window=3, block_words=block_words)
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == [(1, 42, 40, ("x",)), (2, 3, 3, ()), (2, 3, 3, ()), (3, 0, 0, ())]
    assert {(r["doc_id"], r["item_id"], r["lo"], r["hi"]) for r in D.longest_matches(docs, bench, window=3).collect()} == {(1, "x", 1, 41), (2, None, 0, 3)}


@pytest.mark.parametrize("seed", range(3))
def test_longest_matches_equal_brute_force(spark, seed):
    rows, items = texts(20 + seed, 40), [(str(i), t) for i, t in texts(40 + seed, 10)]
    got = D.longest_matches(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id string, text string"), window=4)
    assert sorted((r["doc_id"], r["item_id"], r["lo"], r["hi"]) for r in got.collect()) == brute.longest(rows, items, 4)


def test_longest_matches_and_removal(spark):
    docs = spark.createDataFrame([(1, "x a b c d y", "z"), (2, "none of it", None)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([("q", "A b, c")], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"], r["lo"], r["hi"]) for r in D.longest_matches(docs, bench, window=10).collect()] == [(1, "q", 1, 4)]
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "none of it", None)]
    assert D.remove_contaminated(docs, bench.limit(0)).count() == 2 and D.contamination(docs.limit(0), bench).count() == 0


def longest(docs, items, n):
    """Longest common stretches of n words or more, or of whole shorter items, by the table of common suffixes."""
    out = set()
    for i, t in docs:
        w, found = brute.alnum(t), set()
        for name, u in items:
            v = brute.alnum(u)
            least = min(n, len(v))
            for a in range(len(w)):
                for b in range(len(v)):
                    if a and b and w[a - 1] == v[b - 1]:
                        continue
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    if k >= least:
                        found.add((name, a, a + k))
        out |= {(i, *x) for x in found if not any(x != y and x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in found)}
    return out


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_longest_matches_equal_brute_force(spark, block_words):
    rows = texts(7, 40) + [(9000, None), (9001, "x k l m n o p k l m n o p k"), (9002, "k l m"), (9003, "r"), (9004, "r")]
    items = [(str(i), t) for i, t in texts(8, 12)] + [("500", "k l m"), ("501", None), ("503", "k l m n o p k l m n o p"), ("504", "r"), ("505", "k")]
    got = D.longest_matches(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(items, "item_id string, text string"), window=6, block_words=block_words)
    got = [(r["doc_id"], r["item_id"], r["lo"], r["hi"]) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == longest(rows, items, 6)


def test_a_long_passage_is_one_match(spark):
    passage = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (2, passage), (3, f"{passage} {passage}")], DOCS)
    bench = spark.createDataFrame([("q", f"t {passage} u"), ("r", f"{passage} {passage}")], "item_id string, text string")
    got = sorted((r["doc_id"], r["item_id"], r["lo"], r["hi"]) for r in D.longest_matches(docs, bench).collect())
    assert got == [(1, "q", 2, 302), (1, "r", 2, 302), (2, "q", 0, 300), (2, "r", 0, 300), (3, "q", 0, 300), (3, "q", 300, 600), (3, "r", 0, 600)]


# ---- mixing


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["b", "a", "é", None, "c"]), " ".join(["w"] * rng.randint(0, 60))) for i in range(1500)] + [(5000, "d", None), (None, "d", "x y"), (5001, "empty", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(df, cell_rows=5).toPandas()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.plain(t))
    want = brute.levels(sizes)
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    for s, part in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert part["target"].iloc[0] == pytest.approx(want[s]) and part["source_size"].iloc[0] == sizes[s]
        assert abs(part["taken"].sum() - want[s]) <= 2
    again = M.mix(df.repartition(7), cell_rows=5).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))


def test_mix_of_nothing(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    got = M.mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"], r["target"]) for r in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_mix_runs_in_the_jvm(spark):
    plan = M.mix(spark.createDataFrame([(1, "a", "x y z")], "doc_id long, source string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rates_equal_brute_force(spark):
    rng = random.Random(2)
    cells = [(src, size, rng.randint(1, 30)) for src in ("a", "b", None) for size in sorted(rng.sample(range(1, 400), 12))]
    size = lambda x: sum(s * n for y, s, n in cells if y == x)
    goals = [("a", size("a") * 1.7), ("b", size("b") * 0.3), (None, size(None) * 1.0)]
    mean = lambda x: size(x) / sum(n for y, _, n in cells if y == x)
    tilt = {r["source"]: r["tilt"] for r in M.solve(spark.createDataFrame(cells, "source string, size long, n long"), spark.createDataFrame([(x, t, mean(x)) for x, t in goals], "source string, target double, mean double")).collect()}
    for x, t in goals:
        for s, want in brute.rates([(s, n) for y, s, n in cells if y == x], t, 2.0).items():
            assert 2 / (1 + np.exp(-tilt[x] * s / mean(x))) == pytest.approx(want, abs=1e-4)


def test_mixing_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a", f"w{i % 50} x y") for i in range(300)] + [(7, "a", "p q")] * 5 + [(8, "b", "r")] * 9
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("old"))
    got = sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in M.mix(df, cell_rows=16).collect())
    assert len(got) == len(rows) and got == sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in M.mix(df.repartition(5), cell_rows=16).collect())
    assert sum(t for i, _, t in got if i != 8) == pytest.approx(M.mix(df).where("source = 'a'").first()["target"], abs=3)


# ---- toxicity


def toxic_rows(n=300, seed=2):
    rng = random.Random(seed)
    calm = [f"calm{i}" for i in range(60)]
    out = []
    for i in range(n):
        s = [" ".join(rng.choice(calm) for _ in range(8)) for _ in range(rng.randint(1, 9))]
        y = int(rng.random() < 0.3)
        if y:
            s[rng.randrange(len(s))] += " " + rng.choice(["vilestuff", "vileness", "nastiest"])
        out.append((i, ". ".join(s), y))
    return out


def test_toxicity_learns_sentences(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("old"))
    model = X.train(df, df.where(~X.held_out()).select("doc_id", "toxic"))
    got = X.toxicity(df, model).where(X.held_out()).collect()
    assert len(got) > 30 and all((r["score"] >= 0.5) == bool(r["toxic"]) for r in got)
    assert all(len(r["offending"]) == r["toxic"] and all("vile" in s or "nasti" in s for s in r["offending"]) for r in got)


def test_toxicity_scores_equal_brute_force(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([*rows, (5000, "VileStuff, no. Ärger\nund so!", 0), (5001, None, 0)], "doc_id long, text string, toxic int")
    model = X.train(df, df.where(~X.held_out()).select("doc_id", "toxic"))
    for r in X.toxicity(df, model).collect():
        assert r["score"] == pytest.approx(brute.noisy_or(r["text"], model), abs=1e-5)
    again = X.train(df.repartition(3), df.select("doc_id", "toxic").where(~X.held_out()).repartition(2))
    assert again[0] == model[0] and (again[1] == model[1]).all()


def test_toxicity_training_is_bounded_and_takes_one_text_an_id(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = X.train(df, labels)
    twice = X.train(df.unionByName(df).unionByName(df.where("doc_id < 20")), labels.unionByName(labels))
    assert twice[0] == model[0] and (twice[1] == model[1]).all()
    less = X.train(df, labels, pairs=40)
    assert np.isfinite(less[1]).all() and not (less[1] == model[1]).all()


def test_toxicity_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 100_000), (3, "...\n!?")], DOCS)
    model = X.train(df, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int"))
    got = X.toxicity(df, model).collect()
    assert all(r["score"] < 0.5 for r in got) and X.toxicity(df.limit(0), model).count() == 0


# ---- token counts


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    rng = random.Random(3)
    alphabet = [chr(i) for i in range(0x20, 0x180)] + list("\t\n\x0b\r\x1c\x85\xa0́Σςİǅ漢字🙂‍") + ["'s", "'LL", "<|endoftext|>", "  "] * 6
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "word " * 30_000)]
    lib = Tokenizer.from_file(path)
    got = T.token_counts(spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("old")), path)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got.collect()} == {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert T.token_counts(spark.createDataFrame([], DOCS), path).count() == 0


def test_whole_tokens_are_proved():
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    content = open(P.path("word_bpe_49k.json")).read()
    whole = T.whole_tokens(content)
    lib = Tokenizer.from_str(content)
    assert len(whole) > 30_000 and all(len(lib.model.tokenize(w)) == 1 for w in whole[::500])


# ---- HTML


def test_main_text():
    page = """<!doctype html><html lang=en><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
    <header><p>Site</p></header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookie-notice"><p>We use cookies</p></div><div class="ad">Buy</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>First.<br><p>Second&nbsp; <a href=x>link</a>
    text<ul><li>One<li>Two</ul><div class="ad">Buy <p>now</p></div><form><label>Mail</label></form><p>End.</article>
    <aside>Side</aside><section class="comments"><article class="comment"><p>Nice</p></article></section><footer>&copy; foot</footer></body>"""
    assert H.main_text(page) == "Head & line\n\nFirst.\n\nSecond link text\n\nOne\n\nTwo\n\nEnd."


def test_main_text_without_an_article():
    body = "".join(f"<p>Paragraph {i} says enough to count as text of the page.</p>" for i in range(8))
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><a href=3>Three</a></div><div><a href=4>Four</a></div><div><h2>Title</h2>{body}<p>End.</p></div><div><a href=5>Five</a></div><footer><p>foot</p></footer>"
    got = H.main_text(page).split("\n\n")
    assert got[0] == "Title" and got[-1] == "End." and len(got) == 10


def test_a_box_in_mid_article_does_not_cut_it():
    told = [c * 200 for c in "abc"]
    page = "<body><p>{}<p>{}<p>{}<div class=ad><p>x</p><p>y</p><p>z</p></div><p>{}</body>".format(*told, "d" * 100)
    assert H.main_text(page).split("\n\n") == [*told, "d" * 100]
    page = "<body><p>{}<div class=related><ul><li>x<li>y<li>z</ul></div>{}</body>".format("d" * 100, "".join(f"<p>{t}" for t in told))
    assert H.main_text(page).split("\n\n") == ["d" * 100, *told]
    links = "".join(f"<li><a href={i}>{'l' * 40}</a>" for i in range(4))
    page = f"<body><p>{'a' * 10_000}<ul>{links}</ul><p>{'b' * 2_900}</body>"
    assert H.main_text(page).split("\n\n") == ["a" * 10_000, "b" * 2_900]


def test_short_sibling_articles_stay():
    page = "".join(f"<article><p>{c * n}</p></article>" for c, n in (("a", 1_000), ("b", 40), ("c", 3)))
    assert H.main_text(page).split("\n\n") == ["a" * 1_000, "b" * 40, "c" * 3]
    others = f"<article class=teaser><p>{'t' * 500}</p></article><article><a href=x>{'l' * 500}</a></article><aside><div><article><p>{'s' * 500}</p></article></div></aside><article><p>z</article>"
    assert H.main_text(f"<body><div>{page}{others}</div>").split("\n\n") == ["a" * 1_000, "b" * 40, "c" * 3, "z"]
    assert H.main_text(f"<body><aside><p>Open<article><p>{'a' * 100}</article><article><p>b</article>").split("\n\n") == ["a" * 100, "b"]


def test_surge_and_dive_decide_without_marks():
    links = "<div><a href=1>{}</a></div>".format("l" * 30)
    page = f"<body>{links * 4}<p>{'a' * 900}<p>{'b' * 500}{links}<p>end{links * 4}<div>{'c' * 20}</div>{links * 3}"
    assert H.main_text(page).split("\n\n") == ["a" * 900, "b" * 500, "l" * 30, "end"]
    assert H.main_text(page, window=1).split("\n\n") == ["a" * 900, "b" * 500]  # a line of links is a dive
    assert H.main_text(page, window=9).split("\n\n")[-1] == "c" * 20  # and four are none
    assert H.main_text(page, share=0.0).split("\n\n") == ["a" * 900, "b" * 500, "l" * 30, "end", "c" * 20]


def test_marks_are_weights():
    teaser = f"<article><p>{'t' * 30}</p></article>"
    assert H.main_text(f"<body>{teaser}<div><p>{'a' * 500}</div>") == "t" * 30
    assert H.main_text(f"<body>{teaser}<div><p>{'a' * 50_000}</div>") == "a" * 50_000
    assert H.main_text(f"<body>{teaser}<div><p>{'a' * 500}</div>", mark=1.0).split("\n\n") == ["t" * 30, "a" * 500]


def test_names_that_only_begin_like_boxes_are_none():
    inside = "".join(f"<div {n}><p>{c * 60}</p></div>" for c, n in zip("abcd", ("class='related-work'", "id=share-price", "class='ad-hoc'", "role=note"), strict=True))
    gone = "".join(f"<div {n}><p>{'x' * 60}</p></div>" for n in ("class='related-items'", "id=share-buttons", "class='ad-top'", "class='reader comments'", "class=notice"))
    assert H.main_text(f"<article><p>{'t' * 100}</p>{inside}{gone}</article>").split("\n\n") == ["t" * 100, *[c * 60 for c in "abcd"]]


def test_a_line_of_links_in_mid_text_stays():
    page = "<body>" + "".join(f"<p>{c * 200}" for c in "ab") + f"<p>See <a href=x>{'l' * 80}</a><p>{'c' * 200}"
    assert H.main_text(page).split("\n\n") == ["a" * 200, "b" * 200, "See " + "l" * 80, "c" * 200]


@pytest.mark.parametrize("seed", range(20))
def test_stretches_equal_brute_force(seed):
    rng = random.Random(seed)
    weights = [rng.choice([0, 0, 1, 5, 300]) for _ in range(rng.randint(0, 40))]
    window, least = rng.randint(1, 5), rng.choice([0, 4, 200])
    assert H._stretches(weights, window, least) == brute.stretches(weights, window, least)


@pytest.mark.parametrize("html,want", [("", ""), ("just text", "just text"), ("<p>a<!-- <p>b -->c</p>", "ac"), ("<p>x &lt;b&gt; &#233;", "x <b> é"), ("<p title='a>b'>y</p>", "y"), ("<script>only", "")])
def test_small_pages(html, want):
    assert H.main_text(html) == want


def test_extraction_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", None), (3, "<p>" + "w " * 50_000, "v")], "page_id long, html string, url string").withColumn("n_chars", F.lit("old"))
    got = {r["page_id"]: (r["url"], r["n_chars"]) for r in H.extract_text(df).collect()}
    assert got == {1: ("u", 0), 2: (None, 0), 3: ("v", 99_999)}
    assert H.extract_text(df.limit(0)).count() == 0


# ---- kNN


@pytest.mark.parametrize("pivots,group,block", [(64, 2048, 16384), (5, 3, 20), (1, 1000, 7)])
def test_neighbours_equal_brute_force(spark, pivots, group, block):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 6)), np.tile(rng.normal(size=(1, 6)), (80, 1))])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).repartition(4)
    got = [tuple(r) for r in K.knn_join(df, df.where("vec_id % 10 = 0"), k=7, pivots=pivots, group_rows=group, block_rows=block).collect()]
    v = np.floor(64 * x).astype(np.int64)
    want = []
    for q in range(0, len(v), 10):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:7]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_rings_leave_out_what_no_query_needs():
    """On vectors in clusters few rows are needed, and none that is among a query's best is left out."""
    rng = np.random.default_rng(8)
    points = rng.integers(-400, 400, size=(40, 16))
    x = np.rint(points[rng.integers(0, 40, 4000)] + rng.normal(scale=6, size=(4000, 16))).astype(np.int64)
    cell = ((x[:, None, :] - points[None]) ** 2).sum(axis=2).argmin(axis=1)
    radius = np.sqrt(((x - points[cell]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6
    q = x[::100]
    scores = q @ x.T
    reach = np.sort(scores, axis=1)[:, -21].astype(np.float64)
    largest = np.array([radius[cell == c].max() for c in range(40)])

    class Shared:
        value = (points, np.arange(40), largest)

    import pyarrow as pa

    group = np.arange(len(q), dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([K._packed(q, "<i2"), pa.array(group), pa.array(reach)], names=["v", "group", "reach"])
    found = pa.Table.from_batches(list(K._rings(Shared, "<i2")(iter([batch])))).to_pydict()
    ring = {(g, c): r for g, c, r in zip(found["group"], found["to"], found["ring"], strict=True)}
    need = np.array([[radius[i] >= ring.get((g, cell[i]), np.inf) for i in range(len(x))] for g in group])
    assert need.mean() < 0.1 and (need | (scores < reach[:, None])).all()


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in K.knn_join(df, df.where("vec_id = 0"), k=20).collect()] == [(0, 1, 1, 64 * 32)]
    assert K.knn_join(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_large_components_repeated_ids_and_other_lengths(spark):
    rows = [(0, [3e6, 1.0]), (1, [123456789.0 / 64, 1.0]), (1, [123456789.0 / 64, 2.0]), (2, [-5e6, 3.0]), (20, [7.0]), (21, [2.0]), (40, []), (41, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in K.knn_join(df, df.where("vec_id % 20 = 0"), k=20).collect())
    whole = lambda v: [int(np.floor(64 * x)) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True))
    want = [(0, 1, 1, dot(rows[0][1], rows[2][1])), (0, 2, 1, dot(rows[0][1], rows[1][1])), (0, 3, 2, dot(rows[0][1], rows[3][1])), (20, 1, 21, 448 * 128), (40, 1, 41, 0)]
    assert got == sorted(want) and max(abs(r[3]) for r in want) > 2**53
    twice = spark.createDataFrame([(0, [2.0]), (0, [1.0]), (5, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in K.knn_join(twice, twice.where("vec_id = 0"), k=20).collect()] == [(0, 1, 5, 64 * 64)]
    with pytest.raises(OverflowError):
        K.knn_join(spark.createDataFrame([(0, [1e300, 1.0])], "vec_id long, embedding array<double>"), df, k=3)


# ---- URL filters


def test_keys_and_intervals(spark):
    day = "2024-0{}-01".format
    events = [("l", "domain", "b.org", "add", day(2)), ("l", "domain", "b.org", "add", day(3)), ("l", "domain", "b.org", "drop", day(4)), ("l", "domain", "b.org", "add", day(6)), ("m", "prefix", "x.b.org/p", "add", day(1)), ("m", "host", "x.b.org", "add", day(5)), ("m", "host", "x.b.org", "drop", day(5)), (None, "host", "x.b.org", "add", day(1))]
    ev = spark.createDataFrame(events, "list string, kind string, entry string, action string, at string").withColumn("at", F.col("at").cast("date"))
    urls = [("https://user@WWW.x.B.org.:8080/p/q?z#f", day(3)), ("https://x.b.org/other", day(4)), ("http://b.org", day(7)), ("http://xb.org/p", day(7)), ("nonsense", day(3)), (None, day(3)), ("http://b.org/", None), ("http://x.b.org/pq", day(5))]
    df = spark.createDataFrame(urls, "url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("lists", F.lit("old")).withColumn("id", F.lit(None).cast("string"))
    got = U.filtered(df.unionByName(df.limit(1)), ev)
    assert got.columns == ["url", "fetched", "id", "lists", "n_entries", "blocked"]
    assert sorted((str(r["url"]), r["lists"]) for r in got.collect()) == sorted((str(u), x) for u, x in zip([*[u for u, _ in urls], urls[0][0]], [["l", "m"], [], ["l"], [], [], [], [], [], ["l", "m"]], strict=True))
    assert U.filtered(df, ev.limit(0)).where("blocked").count() == 0 and U.filtered(df.limit(0), ev).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- language ID


def test_fusion_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = G.train(docs, per_language=50)
    rng = random.Random(6)
    some = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()]
    hosts = ["a.example.com", "b.example.com", "de.other.org", "x.site.fr", "es"]
    pages = []
    for i in range(60):
        lang, path = rng.choice(["", " lang=fr", " lang='de-AT'", " lang=xx"]), rng.choice(["/x", "/en/y", "/a/es-mx?q=/de/", ""])
        cut_ = some[i][: rng.choice([0, 20, 200, 5000])]
        pages.append((i, rng.choice([None, "nonsense", *[f"https://{h}{path}" for h in hosts]]), f"<html{lang}><body><p>{cut_}"))
    pages += [(100, "https://q.net/1", None), (101, "https://q.net/2", ""), (102, None, "<p>" + "und die der das " * 40_000), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("declared", F.lit("old")).withColumn("text_log", F.lit(1))
    scored = G.text_scores(df, model, "html", True)
    assert scored.columns == ["page_id", "url", "declared", "text_log"]
    want = brute.languages([(r["page_id"], r["url"], r["text_log"], r["declared"]) for r in scored.collect()], model)
    got = {r["id"]: (r["lang"], r["posterior"]) for r in G.identify(df, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1], abs=1e-9) for k, v in got.items())


def test_equal_posteriors_go_to_the_first_code(spark):
    model = (["aa", "bb"], np.log(np.full((2, 1 << G.BITS), 1.0 / (1 << G.BITS))))
    df = spark.createDataFrame([(1, None, "<p>any text"), (1, None, "<p>any text"), (None, None, None)], "page_id long, url string, html string")
    assert [r["lang"] for r in G.identify(df, model).collect()] == ["aa"] * 3


def test_language_of_texts_and_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = G.train(docs.where("doc_id % 2 = 0"), per_language=200)
    names = F.array(*map(F.lit, model[0]))
    scored = G.text_scores(docs.where("doc_id % 2 = 1 and length(text) > 40"), model, "text", False).withColumn("best", F.element_at(names, F.array_position("text_log", F.array_max("text_log")).cast("int")))
    assert scored.where("best = lang").count() >= 0.97 * scored.count()
    page = "<html lang={}><body><p>{}</p>"
    pages = [(1, "http://h.example.com/de/1", page.format("xx", "")), (2, "http://h.example.com/x", page.format("fr", "")), (3, None, None), (4, "http://h.example.com/2", page.format("en", "und der die das nicht ist von den mit sich"))]
    more = [(10 + i, f"http://k.example.org/{i}", page.format("es", "para los que las una del con por como más")) for i in range(30)] + [(99, "http://k.example.org/x", "")]
    df = spark.createDataFrame(pages + more, "page_id long, url string, html string").withColumn("domain", F.lit("x"))
    got = {r["id"]: r["lang"] for r in G.identify(df, model).collect()}
    assert got[1] == "de" and got[2] == "fr" and got[99] == "es" and got[10] == "es" and len(got) == 35
    assert G.identify(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        G.train(docs.limit(0))
