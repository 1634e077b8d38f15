import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, docs, prose
from tidemark.llm import brown_lm, html_blocks, mixture_packing, quality_divergence, setsketch, spaced_seeds, toxicity_lexicon
from tidemark.llm._components import connected_components
from tidemark.llm.line_frequency import OP5_SQL, drop_boilerplate, op5_line_frequency
from tidemark.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


# 1: language-model scores


def brown_rows(spark, rows, **kw):
    held = F.expr("coalesce(crc32(CAST(doc_id AS string)) % 7 = 2, false)")
    scores, model = brown_lm.brown_scores(docs(spark, rows), ~held, **kw)
    return scores.collect(), model


def trains(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def test_base_scores_are_add_one(spark):
    rows = awkward(1)
    got, _ = brown_rows(spark, rows, top_words=20, classes=8)
    split = [(i, (t or "").encode().lower().split() + [b"\0"]) for i, t in rows]
    c = Counter(w for i, ws in split if trains(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in split)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want


def test_model_beats_base_where_order_matters(spark):
    r = np.random.default_rng(0)
    rows = [(k, " ".join(f"{'ab'[j % 2]}{r.integers(30)}" for j in range(60))) for k in range(120)]
    got, model = brown_rows(spark, rows, top_words=80, classes=8)
    held = [x for x in got if not trains(x["doc_id"])]
    assert held and all(x["score"] > x["base_score"] for x in held)
    # no more than 1 of probability for what follows any item
    p = model.transition
    assert np.allclose(p.sum(axis=1), 1)


def test_words_beyond_the_top_have_classes_of_their_own(spark):
    r = np.random.default_rng(1)
    # all words but "p" and "q" end alike, and three of each kind are frequent; one kind follows "p", the other "q"
    rows = [(k, " ".join(f"{'pq'[j % 2]} {'ab'[j % 2]}{r.integers(3) if r.random() < 0.4 else r.integers(10, 200)}xx" for j in range(40))) for k in range(150)]
    held = [k for k in range(1000, 1100) if not trains(k)][:2]
    right = " ".join(f"p a{j}xx q b{j}xx" for j in range(20, 40))
    wrong = " ".join(f"p b{j}xx q a{j}xx" for j in range(20, 40))
    got, model = brown_rows(spark, [*rows, (held[0], right), (held[1], wrong)], top_words=9, classes=8)
    got = {x["doc_id"]: x for x in got}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 5
    assert model.class_types.sum() == model.types + brown_lm.SHAPES and model.class_count.sum() == model.tokens


def likelihood(n, label):
    one = np.zeros((len(n), label.max() + 1))
    one[np.arange(len(n)), label] = 1
    t = one.T @ n @ one
    return sum(sign * np.sum(x * np.log(np.maximum(x, 1e-300))) for sign, x in ((1, t), (-1, t.sum(0)), (-1, t.sum(1))))


@pytest.mark.parametrize("seed", range(4))
def test_no_exchange_is_left_that_helps(seed):
    n = np.random.default_rng(seed).poisson(3, (30, 30)).astype(float)
    n[:15, 15:] *= 6
    n[15:, :15] *= 6
    label = brown_lm.exchange_classes(n, 4)
    for w in range(30):
        for c in range(4):
            other = label.copy()
            other[w] = c
            assert likelihood(n, other) <= likelihood(n, label) + 1e-6
    assert not set(label[:15]) & set(label[15:])


def test_no_training_documents(spark):
    scores, _ = brown_lm.brown_scores(docs(spark, [(1, "a b"), (2, None)]), F.lit(False))
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in scores.orderBy("doc_id").collect()] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    none, _ = brown_lm.brown_scores(docs(spark, []), F.lit(True))
    assert none.collect() == []


# 3: main text

PAGES = [
    ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One &amp; two<br>three<p><b>Four</article><footer>&copy; x</footer>", "T\n\nOne & two three\n\nFour"),
    ('<div class="cookie-banner">We use cookies</div><main><p>Text  of\nit</p></main><section class="comments"><p>I say no</p></section>', "Text of it"),
    ('<article><p>a</p><aside>See also</aside><form>Mail <input></form><p>b<script>var x = "</p>";</script></p><div class="ad">Buy</div></article>', "a\n\nb"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<style>p{}</style><!-- <p>x</p> --><nav>menu</nav>", ""),
    (None, ""),
    ("", ""),
]


def test_main_text(spark):
    df = spark.createDataFrame([(k, "u", h, "x") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, id string")
    got = html_blocks.extract_main_text(df, keep=("url",)).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_blocks.extract_main_text(df.limit(0)).collect() == []


def test_tree_on_its_table():
    x, y = html_blocks.labelled_blocks()
    tree = html_blocks.train_tree(x, y)
    assert np.mean([html_blocks.classify(tree, tuple(f)) == t for f, t in zip(x, y, strict=True)]) > 0.97


def test_plain_page_without_containers():
    tree = html_blocks.train_tree(*html_blocks.labelled_blocks())
    long = "word " * 60
    assert html_blocks.main_text(f"<div><a href=x>Home</a> <a href=y>News</a></div><div>{long}</div><div>{long}</div>", tree)[0] == "\n\n".join([long.strip()] * 2)


# 4: toxicity


def test_folding():
    f = toxicity_lexicon.fold_word
    assert f("1D10T!!") == f("іdіоt") == f("i.d.i.o.t") == f("ìdïõt") == f("ｉｄｉｏｔ") == "idiot"
    assert f("stuuuupid") == "stupid" and f("2024") == "2024" and f("...") == ""


def test_toxic_words_are_learned_and_exceptions_respected(spark):
    rows = []
    for k in range(300):
        text = prose(k, 60, 80)
        if k % 5 == 0:
            text = text[:100] + " grobnix " + text[100:] + " grobnixer"
        if k % 5 == 1:
            text += " grobnixian society"
        rows.append((k, text, int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_lexicon.fit_toxicity(df)
    assert any("grob" in e for e in model.entries)
    test = docs(spark, [(1, prose(999, 80, 80) + " gr0bn1x"), (2, prose(998, 80, 80)), (3, None), (4, ""), (5, prose(997, 50, 80) + " grobnixian society"), (None, "grobnix")])
    got = {r["doc_id"]: r for r in toxicity_lexicon.score_toxicity(test, model).collect()}
    assert [got[k]["predicted"] for k in (1, 2, 3, 4, 5, None)] == [1, 0, 0, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "b", 0)], "doc_id long, text string, toxic int")
    model = toxicity_lexicon.fit_toxicity(df)
    assert model.constant == 0.0
    assert toxicity_lexicon.score_toxicity(docs(spark, [(1, "x")]), model).first()["score"] == 0.0
    assert toxicity_lexicon.score_toxicity(docs(spark, []), model).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op4_toxicity_lexicon"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, n = scored.agg(F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert right / n > 0.93


# 5: line frequency


def test_lines(spark):
    rows = [(k, f"Menu\nbody {k}\n\nMenu \nend", "en", "a") for k in range(6)] + [(6, "body 6", "en", "a"), (7, None, "en", "a"), (8, "", "en", "a"), (9, "Menu\nx", "en", "b"), (10, "Menu", "en", None)]
    got = {r["doc_id"]: r for r in drop_boilerplate(docs(spark, rows), max_ratio=0.5, min_pages=5).collect()}
    assert got[0]["kept_text"] == "body 0\n" and (got[0]["n_lines"], got[0]["n_dropped"]) == (5, 3)
    assert (got[7]["kept_text"], got[7]["n_lines"], got[8]["kept_text"], got[9]["kept_text"], got[10]["kept_text"]) == (None, 0, "", "Menu\nx", "Menu")
    assert drop_boilerplate(docs(spark, [])).collect() == []


def test_lines_by_the_join_beyond_the_broadcast(spark, monkeypatch):
    from tidemark.llm import line_frequency

    rows = [(k, f"Menu\nbody {k}", "en", "a") for k in range(8)]
    want = sorted(map(tuple, drop_boilerplate(docs(spark, rows)).collect()))
    monkeypatch.setattr(line_frequency, "MAX_BROADCAST_LINES", -1)
    assert sorted(map(tuple, drop_boilerplate(docs(spark, rows)).collect())) == want


def test_text_copied_over_a_third_of_a_host_stays(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    copy = "\n".join(prose(900 + k, 20) for k in range(5))
    rows = [(k, "Menu\n" + "\n".join(prose(1000 + 9 * k + j, 20) for j in range(4)), "en", "a") for k in range(200)] + [(500 + k, copy, "en", "a") for k in range(100)]
    full = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    lined = pipeline.line_dedup(spark, full, "").persist()
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert all(texts[k] == copy for k in range(500, 600))
    assert all("Menu" not in texts[k] and len(texts[k].split("\n")) == 4 for k in range(200))
    left = [r["text"] for r in pipeline.near_dedup(spark, lined, "").collect()]
    assert left.count(copy) == 1 and len(left) == 201


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_lines_are_those_of_sql(spark):
    assert ORACLE["op5_line_frequency"] == OP5_SQL
    duckdb.sql(f"create or replace view documents as select * from '{DATA}/documents.parquet'")
    assert sorted(map(tuple, op5_line_frequency(spark, DATA).collect())) == sorted(duckdb.sql(OP5_SQL).fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_substring_words", "op9_setsketch"])
def test_rows_are_those_of_sql(spark, name):
    duckdb.sql(f"create or replace view documents as select * from '{DATA}/documents.parquet'")
    mine, theirs = QUERIES[name](spark, DATA), duckdb.sql(ORACLE[name])
    assert mine.columns == theirs.columns
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())


# 6: packing


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(k, prose(k, 10 + 37 * (k % 9)) + " Ünï—中文 12345 <|endoftext|>" * (k % 3), "en", "abc"[k % 3] if k % 10 else None) for k in range(60)] + [(100, None), (101, ""), (None, "x"), (5, prose(5, 195))]
    got = mixture_packing.pack_mixture(docs(spark, rows), sequence=64, quantum=16, parts=3).collect()
    want = Counter((i, *exact.encode(t or "", add_special_tokens=False).ids, 0) for i, t, *_ in rows)
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces[(r["doc_id"], r["source"], r["doc_tokens"])].append(r)
    assert sum(r["length"] for r in got) == sum(n * (len(k) - 1) for k, n in want.items())
    for (i, _, n), rs in pieces.items():
        if i != 5:
            rs.sort(key=lambda r: r["start"])
            ids = [x for r in rs for x in r["ids"]]
            assert len(ids) == n and (i, *ids) in want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    short = 0
    for at in places.values():
        end = 0
        for o, n in sorted(at):
            assert o == end
            end += n
        short += end < 64
    assert short <= 3


def test_round_robin_keeps_to_targets():
    drr = mixture_packing.DeficitRoundRobin({"a": 0.75, "b": 0.25}, {}, 100, 10)
    out = list(drr.pack({"a": [(0, 3000)], "b": [(1, 500), (2, 500)]}))
    for window in range(40):
        a = sum(n for d, _, n, w, _ in out if w == window and d == 0)
        assert abs(a - 75) <= 10
    assert sum(n for _, _, n, _, _ in out) == 4000


def deviations(rows, sequence):
    """The largest gap between a full window's share of a source and the corpus's, by window."""
    total, windows = Counter(), defaultdict(Counter)
    for r in rows:
        total[r["source"]] += r["length"]
        windows[r["sequence_id"]][r["source"]] += r["length"]
    every = sum(total.values())
    return [max(abs(w[s] / sequence - n / every) for s, n in total.items()) for w in windows.values() if sum(w.values()) == sequence]


@pytest.mark.parametrize("parts", [1, 5])
def test_every_full_window_has_the_mixture_of_skewed_sources(spark, parts):
    # 20 sources, the first with a third of all rows, the last with one; lengths from 1 to 3000 words
    rows, r = [], np.random.default_rng(3)
    for k in range(400):
        s = 0 if k % 3 == 0 else 19 if k == 1 else int(r.zipf(1.5)) % 19
        rows.append((k, prose(k, 3000 if k % 97 == 0 else int(r.integers(1, 200))), "en", f"s{s}"))
    got = mixture_packing.pack_mixture(docs(spark, rows).repartition(7), sequence=256, quantum=8, parts=parts).collect()
    gaps = deviations(got, 256)
    assert len(gaps) > 100 and max(gaps) < 0.1
    filled = Counter()
    for x in got:
        filled[x["sequence_id"]] += x["length"]
    assert sum(n < 256 for n in filled.values()) <= parts


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_mixture_and_ids_of_whole_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_mixture_packing"](spark, sf).collect()
    gaps = deviations(got, 1024)
    assert len(gaps) > 900 and max(gaps) < 0.1
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for x in got:
        pieces[x["doc_id"]].append((x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]))
    for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*exact.encode(x["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for start, n, crc, tokens in sorted(pieces[x["doc_id"]]):
            assert (start, tokens, crc) == (at, len(ids), zlib.crc32(ids[start : start + n]))
            at += n
        assert at == len(ids)


def test_ids_are_those_of_tokenizers_for_any_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = np.random.default_rng(0)
    ranges = [(9, 14), (32, 127), (160, 0x24F), (0x370, 0x600), (0x900, 0xA00), (0x2000, 0x2070), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE00, 0xFFFE), (0x1F300, 0x1FAFF), (0x20000, 0x20100)]
    texts = []
    for _ in range(3000):
        lo, hi = ranges[r.integers(len(ranges))]
        texts.append("".join(chr(r.integers(lo, hi)) if r.random() < 0.7 else chr(r.integers(9, 127)) for _ in range(r.integers(0, 60))))
    texts += ["  a  b\t\n\r\n c'll I'VE '", "x" * 5000, " " * 3000, "\u200d\ufeff\u0000", "1234567890" * 50, "<|endoftext|>a"]
    assert mixture_packing.encoder("byte_bpe_50k.json")(texts) == [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]


def test_a_text_longer_than_a_row_of_ids(spark, monkeypatch):
    monkeypatch.setattr(mixture_packing, "CHUNK", 100)
    rows = [(1, prose(1, 2000), "en", "a"), (2, prose(2, 30), "en", "b"), (3, None, "en", "b")]
    got = mixture_packing.pack_mixture(docs(spark, rows), sequence=128, quantum=8, parts=3).collect()
    ids = mixture_packing.encoder("byte_bpe_50k.json")([t or "" for _, t, _, _ in rows])
    for (i, *_), mine in zip(rows, ids, strict=True):
        pieces = sorted((r["start"], r["ids"], r["doc_tokens"]) for r in got if r["doc_id"] == i)
        assert [x for _, p, _ in pieces for x in p] == [*mine, 0] and {n for _, _, n in pieces} == {len(mine) + 1}


def test_targets_and_missing_sources(spark):
    rows = [(k, prose(k, 100), "en", "ab"[k % 2]) for k in range(20)]
    got = mixture_packing.pack_mixture(docs(spark, rows), targets={"a": 1.0}, parts=2).collect()
    assert {r["doc_id"] for r in got} == set(range(20))
    with pytest.raises(ValueError):
        mixture_packing.pack_mixture(docs(spark, rows), targets={"a": -1.0})
    assert mixture_packing.pack_mixture(docs(spark, [])).collect() == []


# 8: decontamination


def test_substitutions_are_tolerated(spark, monkeypatch):
    item = prose(1, 30).split()
    changed = [w if k % 7 else "other" for k, w in enumerate(item)]
    rows = [(1, prose(2, 50) + " " + " ".join(item) + " " + prose(3, 50)), (2, " ".join(changed) + " " + prose(4, 20)), (3, prose(5, 200)), (4, None), (5, ""), (6, " ".join(w.upper() + "," for w in item)), (7, " ".join(item[:8])), (8, "seven small words stand here for you")]
    rows += [(9, "too short"), (10, "this is too short"), (11, "a b nine words of which one may be another c"), (12, "a b nine words of which one must be another c"), (None, " ".join(item)), (1, rows[0][1]), (13, prose(6, 30_000) + " " + " ".join(changed))]
    bench = spark.createDataFrame([(1, " ".join(item), 5), (1, " ".join(item), 6), (2, None, 5), (3, "too short", 5), (4, "Seven small words stand here for you", 5), (5, "nine words of which one may be another", None), (6, "", 1), (None, "too short", 1)], "item_id long, text string, k1 long")
    got = spaced_seeds.decontaminate(docs(spark, rows), bench).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["contaminated"] for k in range(1, 14)] == [True, True, False, False, False, True, False, True, True, False, True, True, True] and by_id[None]["contaminated"]
    assert by_id[1]["n_items"] == 1 and by_id[1]["best_match"] == 30 and by_id[12]["best_match"] == 7
    assert [h["item"] for h in by_id[9]["hits"]] == [3, None]
    monkeypatch.setattr(spaced_seeds, "MAX_SENT_SEEDS", 1)
    monkeypatch.setattr(spaced_seeds, "MAX_SENT_BYTES", 1)
    assert sorted(map(str, spaced_seeds.decontaminate(docs(spark, rows), bench).collect())) == sorted(map(str, got))
    assert not any(r["contaminated"] for r in spaced_seeds.decontaminate(docs(spark, rows), bench.limit(0)).collect())
    assert spaced_seeds.decontaminate(docs(spark, []), bench).collect() == []


def test_overlaps_equal_brute_force(spark):
    """Each document against each item on every diagonal, on documents with planted passages."""
    r = np.random.default_rng(5)
    items = [prose(100 + k, n, 60).split() for k, n in enumerate((3, 5, 7, 8, 9, 11, 12, 15, 16, 20, 24, 25, 30, 40, 59))]
    rows = []
    for k in range(90):
        mine = list(items[k % len(items)])
        if k < 60:
            for at in r.choice(len(mine), int(len(mine) * r.choice([0, 0.1, 0.2, 0.3])), replace=False):
                mine[at] = f"new{at}"
        else:
            mine = mine[: len(mine) // 2]
        rows.append((k, " ".join([*prose(k, int(r.integers(0, 60)), 60).split(), *mine, *prose(1000 + k, int(r.integers(0, 60)), 60).split()])))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {x["doc_id"]: {h["item"] for h in x["hits"]} for x in spaced_seeds.decontaminate(docs(spark, rows), bench).collect()}
    tokens = spaced_seeds.Tokens()
    known = [tokens(" ".join(x).encode()) for x in items]
    want, n = {}, 0
    for i, text in rows:
        doc = tokens(text.encode())
        want[i] = {k for k, item in enumerate(known) if any(spaced_seeds.contaminating(doc, item, d) for d in range(-len(item) + 1, len(doc)))}
        n += len(want[i])
        assert got[i] <= want[i]
    assert n > 40 and sum(len(x) for x in got.values()) >= 0.95 * n


@pytest.mark.parametrize(("n", "replaced"), [(8, 1), (9, 2), (11, 2), (12, 3), (15, 3), (16, 4), (20, 5), (24, 6), (30, 6), (40, 10), (59, 14)])
def test_recall_of_seeds(n, replaced):
    """Of overlaps that contaminate, at least 0.9 have a hit on their diagonal."""
    r, hit, all_ = np.random.default_rng(n), 0, 0
    for _ in range(400):
        item = r.integers(0, 1 << 60, n).astype(np.uint64)
        doc = item.copy()
        doc[r.choice(n, replaced, replace=False)] += np.uint64(1)
        if spaced_seeds.contaminating(doc, item, 0):
            all_ += 1
            hit += any((spaced_seeds.masked(doc, m, w) == spaced_seeds.masked(item, m, w)).any() for w, m in spaced_seeds.kinds(n))
    assert all_ > 100 and hit >= 0.9 * all_


def test_filter_lets_all_known_pass(spark):
    r = np.random.default_rng(0)
    known = r.integers(-(1 << 63), 1 << 63, 5000)
    may = spaced_seeds.filter_of(spark.createDataFrame([(int(h),) for h in known], "hash long"), 5000)
    assert len(may(known.view(np.uint64))) == 5000
    assert len(may(r.integers(0, 1 << 63, 100_000).astype(np.uint64))) < 1000


# 9: near duplicates


def brute_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_brute_force(spark, seed):
    rows = [(i, t) for i, t in awkward(seed) if i is not None] + [(40, prose(seed, 1500).upper()), (None, prose(3, 77))]
    got = setsketch.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert setsketch.near_duplicates(docs(spark, [])).collect() == []


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    monkeypatch.setattr(setsketch, "MEETS", 5)
    base = prose(0, 300).split()
    rows = []
    for k in range(60):
        mine = list(base)
        for j in range(k % 6 * 2):
            mine[(k * 31 + j * 17) % 300] = f"n{k}{j}"
        rows.append((k, " ".join(mine)))
    got = setsketch.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_rows_sent_are_linear_in_a_bucket_with_one_outlier(spark):
    n = 10_000
    members = spark.range(n).select(F.lit(5).cast("long").alias("bucket"), F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("v"), F.when(F.col("id") == 17, F.lit("x")).otherwise(F.lit("a")).cast("binary").alias("label"), F.unhex(F.lit("00000000")).alias("pivot"))
    blocks = -(-n // setsketch.MEETS)
    got = setsketch._blocks(members)
    assert got.count() == n - 1 + blocks
    # every other member meets the outlier once
    pairs = got.filter("NOT minor").select("i", "j", F.col("v").alias("y")).join(got.filter("minor").select("i", "j", F.col("v").alias("x")), ["i", "j"])
    assert pairs.count() == n - 1 and pairs.select("y").distinct().count() == n - 1
    assert setsketch._blocks(members.filter("label = X'61'")).count() == 0


def test_a_hot_class_is_told_without_one_task(spark):
    """A text in a third of all rows, and texts without words in another: each row gets its component."""
    rows = [(k, "the same words all over again") for k in range(900)] + [(1000 + k, " ") for k in range(900)] + [(3000 + k, prose(k, 40)) for k in range(900)]
    got = setsketch.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter([(k, 0, k == 0) for k in range(900)] + [(k, k, True) for k in [*range(1000, 1900), *range(3000, 3900)]])


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_recall_on_documents(spark):
    """Links of ids divisible by 50 with all rows, by brute force: both in one component."""
    sf = "/root/testdata/sf0.01"
    comp = {r["doc_id"]: r["component_id"] for r in QUERIES["op9_setsketch"](spark, sf).collect()}
    sets = {r["doc_id"]: set(setsketch.shingles((r["text"] or "").encode().lower().split()).tolist()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    linked = found = 0
    for i in (i for i in sets if i % 50 == 0):
        for k, other in sets.items():
            both = len(sets[i] & other)
            if i != k and both and 100 * both >= 85 * (len(sets[i]) + len(other) - both):
                linked += 1
                found += comp[i] == comp[k]
    assert linked and found == linked


def test_registers_merge_and_estimate():
    r = np.random.default_rng(0)
    items = setsketch.mix(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    a, b = items[:2000], items[1000:]
    assert (setsketch.merge_registers(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(items)).all()
    e = setsketch.estimate(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(e - 1 / 3) < 0.12


def test_one_of_each_group_stays(spark):
    rows = [(i, t) for i, t in awkward(2)]
    kept = setsketch.deduplicate(docs(spark, rows), percent=85, keep=("text", "source")).collect()
    comps = {c for i, n, c in brute_components([(i, t) for i, t in rows]) if n}
    with_words = [r for r in kept if (r["text"] or "").split()]
    assert sorted(r["doc_id"] for r in with_words) == sorted(comps)
    assert len(kept) - len(with_words) == sum(not (t or "").split() for _, t in rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = connected_components(links).collect()
    assert {(r["v"] < 60, r["label"]) for r in got} == {(True, 0), (False, 100)} and len(got) == 53


# 10: quality


def test_base_counts(spark):
    text = "a b c a b c x\n\nDup # line\nDup # line\n" + prose(1, 60)
    rows = [(1, text), (2, None), (3, ""), (4, "ab " * 80), (5, text), (None, text)]
    got = quality_divergence.quality_rules(docs(spark, rows)).collect()
    for r in got:
        t = dict((i, t) for i, t in rows)[r["doc_id"]] or ""
        w = t.split()
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed)
        assert not (r["kept"] and failed)
    assert quality_divergence.quality_rules(docs(spark, [])).collect() == []


def test_divergence_by_hand(spark):
    rows = [(k, prose(k, 80, 40)) for k in range(20)] + [(50, "$$$ ### " * 60 + prose(9, 60, 40)), (51, " ".join(w + "#" for w in prose(8, 60).split()))]
    got = {r["doc_id"]: r for r in quality_divergence.quality_rules(docs(spark, rows)).collect()}
    chars = sum((quality_divergence.char_histogram(t) for _, t in rows), np.zeros(8, dtype=int))
    p, q = quality_divergence.char_histogram(rows[3][1]) / len(rows[3][1]), chars / chars.sum()
    m = (p + q) / 2
    js = sum(x * math.log2(x / y) / 2 for a in (p, q) for x, y in zip(a, m, strict=True) if x > 0)
    assert got[3]["char_divergence"] == pytest.approx(math.sqrt(js)) and got[3]["kept"] and not got[50]["kept"]
    assert got[50]["char_divergence"] > 0.3


def test_long_texts_without_common_words_go_and_short_clean_ones_stay(spark):
    def text(seed, n, common):
        r = np.random.default_rng(seed)
        return " ".join(f"{common}{'abcdefghij'[r.integers(10)]}" if r.random() < 0.32 else "".join(chr(97 + x) for x in r.integers(26, size=7)) for _ in range(n))

    rows = [(k, text(k, 60 if k % 2 else 600, "th"), "en") for k in range(80)] + [(100 + k, text(100 + k, 600, "quonk"), "en") for k in range(3)]
    # the corpus has ten common words; with more asked for, those of the odd texts would be among them
    got = {r["doc_id"]: r for r in quality_divergence.quality_rules(docs(spark, [(i, t, lang, "s") for i, t, lang in rows]), top=10).collect()}
    assert all(got[k]["kept"] for k in range(80))
    assert not any(got[k]["kept"] for k in (100, 101, 102)) and got[100]["word_divergence"] < 0.47


def test_word_divergence_and_verdict_equal_brute_force(spark):
    """The true top words whatever their length, ties to the smaller word, nulls as a language of their own."""
    rows = [(k, "Furthermore notwithstanding " * (3 * (k % 4)) + prose(k, 60 + 30 * (k % 7), 90) + (" $%" * (40 * (k % 5))), ("en", "de", None)[k % 3], "s") for k in range(60)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (None, prose(1, 80, 90), "de", "s"), (3, rows[3][1], "en", "s"), (102, prose(2, 20_000, 90), "de", "s")]
    got = quality_divergence.quality_rules(docs(spark, rows), top=8).collect()
    assert len(got) == len(rows)
    words, chars = defaultdict(Counter), defaultdict(lambda: np.zeros(8))
    for _, t, lang, _ in rows:
        words[lang].update((t or "").lower().split())
        chars[lang] += quality_divergence.char_histogram(t or "")
    assert any(w in ("furthermore", "notwithstanding") for c in words.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:8])

    def js(p, q):
        p, q = np.array(p, dtype=float) / sum(p), np.array(q, dtype=float) / sum(q)
        return math.sqrt(sum(x * math.log2(x / ((a + b) / 2)) / 2 for a, b in zip(p, q, strict=True) for x in (a, b) if x > 0))

    want = []
    for i, t, lang, _ in rows:
        mine = (t or "").lower().split()
        common = [w for w, _ in sorted(words[lang].items(), key=lambda x: (-x[1], x[0]))[:8]]
        c, every = Counter(mine), words[lang]
        p, q = [[*(x[w] for w in common), x.total() - sum(x[w] for w in common)] for x in (c, every)]
        dc = js(quality_divergence.char_histogram(t), chars[lang]) if t and len(t) >= 200 else None
        dw = js(p, q) if len(mine) >= 50 else None
        three = Counter(zip(mine, mine[1:], mine[2:], strict=False))
        hit = {k + j for k in range(len(mine) - 2) if three[tuple(mine[k : k + 3])] > 1 for j in range(3)}
        limit = 1.0
        if dw is not None:
            absent = js([0] * 8 + [1], q)
            noise = quality_divergence.sampling_distance(np.array(q) / sum(q), len(mine))
            limit = min(0.47, noise + 0.6 * (absent - noise)) if absent > noise else 0.47
        kept = len(mine) >= 50 and 100 * len(hit) <= 50 * len(mine) and not (dc or 0) > 0.3 and not (dw or 0) > limit
        want.append((i, lang, dc, dw, kept))
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1:]))
    langs = Counter((i, lang) for i, _, lang, _ in rows)
    assert langs
    mine = sorted(((r["doc_id"], None if r["char_divergence"] is None else round(r["char_divergence"], 9), None if r["word_divergence"] is None else round(r["word_divergence"], 9), r["kept"]) for r in got), key=key)
    theirs = sorted(((i, None if a is None else round(a, 9), None if b is None else round(b, 9), k) for i, _, a, b, k in want), key=key)
    assert mine == theirs and any(k for *_, k in theirs) and any(not k and b is not None for _, _, b, k in theirs)


def test_more_languages_than_are_sent(spark, monkeypatch):
    rows = [(k, prose(k, 70), f"l{k % 3}", "s") for k in range(9)]
    want = sorted((r["doc_id"], r["word_divergence"]) for r in quality_divergence.quality_rules(docs(spark, rows)).collect())
    monkeypatch.setattr(quality_divergence, "MAX_SENT_LANGUAGES", 1)
    assert sorted((r["doc_id"], r["word_divergence"]) for r in quality_divergence.quality_rules(docs(spark, rows)).collect()) == want


# all


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs_ = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = docs_, docs_.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.stored(stage(spark, before, DATA), name)
        assert after.columns == columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality_rules":
            assert before.count() - after.count() == quality_divergence.quality_rules(before).filter("NOT kept").count()
        if name == "line_dedup":
            assert after.count() == before.count()
        if name == "near_dedup":
            kept = [(r["doc_id"], r["text"]) for r in after.collect()]
            want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 80)
            assert sorted(i for i, _ in kept) == sorted({c for _, _, c in want})
        if name == "decontamination":
            found = spaced_seeds.decontaminate(before, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert after.count() == found.filter("NOT contaminated").count()
        before = after
    packed = pipeline.run(spark, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}


def test_plain_words_fold_like_any_other():
    import random

    from tidemark.llm.toxicity_lexicon import _fold_any, fold_word

    r = random.Random(5)
    for _ in range(20_000):
        word = "".join(r.choice("aabCz019!.,;:?\"')]}([{@$-_*|+é»") for _ in range(r.randrange(9)))
        assert fold_word(word) == _fold_any(word), word


def test_exceptions_take_out_the_matches_inside_them():
    import random

    from tidemark.llm.toxicity_lexicon import ToxicityModel

    r = random.Random(6)
    model = ToxicityModel(entries={" ab ": 2.0, " abc": 3.0, " b ": 1.0}, exceptions=[" ab b ", " c ab ", " abcd "])
    matcher = model.matcher()
    for _ in range(500):
        words = [r.choice(["ab", "abc", "abcd", "b", "c"]) for _ in range(r.randrange(12))]
        text = " " + " ".join(words) + " "
        spans = [(k, k + len(e) - 1) for e in model.exceptions for k in range(len(text)) if text.startswith(e, k)]
        want = {}
        for e, w in model.entries.items():
            for k in range(len(text)):
                if text.startswith(e, k) and not any(lo <= k < hi for lo, hi in spans):
                    want[k] = max(w, want.get(k, 0.0))
        assert matcher.hits(words) == want
