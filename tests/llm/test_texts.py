import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm.leak import Passages, Shard, WordShapes, align, bands, leaked_passages, matches, reach, seed_spread, without_leaks
from strandline.llm.pack import pack_texts, plan_containers, token_counts
from strandline.llm.subjects import WordHashes, fit_subjects, sentences, subject_areas, subject_counts
from strandline.llm.words import coded_words, fold, words

# words -----------------------------------------------------------------------------------------------------------


def test_words():
    assert words(None) == words("") == []
    assert words("A<br/>b&#44; c​d  Zeich-\nnung") == ["a", "b", "cd", "zeichnung"]
    assert words("dafÃ¼r") == ["dafür"] and words("für") == ["für"]
    texts = ["A<br/>b&#44; c​d  Zeich-\nnung", None, "", "für_die «Sache» 12,5 ½ 日本 😀x", "dafÃ¼r", "a\nb" * 50]
    different, codes, n = coded_words(texts)
    assert [different[c] for c in codes] == [fold(w) for t in texts for w in words(t)] and n.tolist() == [len(words(t)) for t in texts]
    assert coded_words([])[2].tolist() == []


# packing ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_every_item(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    p = plan_containers(histogram, 100)
    held = {}
    for pattern, m in zip(p.patterns, p.times):
        assert sum(n * k for n, k in pattern.items()) <= 100
        for n, k in pattern.items():
            held[n] = held.get(n, 0) + k * m
    assert held == histogram
    assert p.lower_bound <= sum(p.times) <= 1.05 * max(p.lower_bound, (lengths > 50).sum()) + 1


def test_small_packings_against_brute_force():
    def least(items, capacity):
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= items[i]:
                    place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(5)
    for _ in range(8):
        items = sorted(rng.integers(2, 15, 9).tolist(), reverse=True)
        p = plan_containers({n: items.count(n) for n in set(items)}, 20, rounds=40)
        assert sum(p.times) <= least(items, 20) + 1
    assert plan_containers({}, 10).patterns == []


@pytest.mark.parametrize("times", [1, 100])
def test_triplets_are_packed_by_the_program(times):
    rng = np.random.default_rng(19)
    histogram = {}
    for _ in range(200):
        a = int(rng.integers(260, 480))
        b = int(rng.integers(max(251, 501 - a), min(499, 749 - a)))
        for n in (a, b, 1000 - a - b):
            histogram[n] = histogram.get(n, 0) + times
    p, greedy = plan_containers(histogram, 1000), plan_containers(histogram, 1000, rounds=0)
    best = 200 * times
    assert best <= sum(p.times) <= 1.02 * best < 1.05 * best < sum(greedy.times) and p.from_lp > 0.95 * sum(p.times)
    assert 0.99 * best <= p.lp_bound <= best + 1e-6 and best - 1e-6 <= p.lp_value <= 1.02 * best
    assert p.lower_bound <= best


def test_prices_bound_the_packing():
    p = plan_containers({51: 60, 27: 60, 26: 60, 23: 120}, 100)
    assert sum(p.times) == p.lower_bound == 90 and sum(plan_containers({51: 60, 27: 60, 26: 60, 23: 120}, 100, rounds=0).times) > 100
    assert sum(plan_containers({1: 5}, 1).times) == 5 and sum(plan_containers({7: 3, 5: 1}, 7).times) == 4


def test_pack_texts(spark):
    rng = np.random.default_rng(6)
    texts = ["word " * int(k) for k in rng.integers(1, 60, 150)] + ["same text again"] * 80 + ["long " * 333, "", None, "x"]
    df = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "id long, text string").withColumn("whole", F.lit(1)).withColumn("n", F.lit("z"))
    size = {r["id"]: r["n_tokens"] for r in token_counts(df, "id", "text").collect()}
    out = pack_texts(df, "id", "text", 64).collect()
    room, by = {}, {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
        if r["container"] is not None:
            room[r["container"]] = room.get(r["container"], 0) + r["n_tokens"]
    assert by.keys() == size.keys() and max(room.values()) <= 64
    for i, n in size.items():
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in parts) == n and (len(parts) == 1 or n > 64)
        assert [r["start"] for r in parts] == [64 * k for k in range(len(parts))]
        assert (parts[0]["container"] is None) == (n == 0)
    assert sorted(room) == list(range(len(room))) and len(room) <= 1.05 * sum(size.values()) / 64 + 1
    assert pack_texts(df.limit(0), "id", "text", 64).count() == 0


# leaks -----------------------------------------------------------------------------------------------------------

RNG = np.random.default_rng(7)
LEXICON = ["".join(RNG.choice(list("abcdefghijklmnop"), 6)) for _ in range(5000)]
STOCK = " ".join(LEXICON[:40])


def prose(n, rng):
    return [LEXICON[i] for i in rng.integers(50, 5000, n)]


def test_matches_against_brute_force():
    rng = np.random.default_rng(8)
    few = LEXICON[:6]
    p = Passages([(i, " ".join(rng.choice(few, 40))) for i in range(3)])
    text = [str(w) for w in rng.choice(few + ["zzz"], 300)] + p.words[0][5:33] + ["zzz"] + p.words[0][5:33]
    a, b, n = matches(Shard([" ".join(text)]).ids(p), p, p.seed_of >= 0)
    got = set(zip((p.item[a]).tolist(), p.at[a].tolist(), b.tolist(), n.tolist()))
    want = set()
    for k, w in enumerate(p.words):
        for i in range(len(w)):
            for j in range(len(text)):
                if w[i] == text[j] and not (i and j and w[i - 1] == text[j - 1]):
                    m = 0
                    while i + m < len(w) and j + m < len(text) and w[i + m] == text[j + m]:
                        m += 1
                    if m >= 4:
                        want.add((k, i, j, m))
    assert got == want and len(a) == len(want) and len(p.seeds(np.array([1, 2]))) == 0


def test_seeds_of_very_many_words():
    rng = np.random.default_rng(15)
    text = [f"w{i}" for i in rng.integers(0, 400_000, 180_000)]
    p = Passages([(1, " ".join(text))])
    assert len(p.vocabulary) > 140_000
    found = p.seeds(Shard([" ".join(text)]).ids(p))
    assert (found[: len(text) - 3] == p.seed_of[: len(text) - 3]).all() and (found[: len(text) - 3] >= 0).all()
    assert (p.seeds(Shard([" ".join(text[::-1])]).ids(p)) < 0).mean() > 0.99
    again = [*text[1000:1300], "zzz", *text[177_000:]]
    a, b, n = matches(Shard([" ".join(again)]).ids(p), p, p.seed_of >= 0)
    assert (1000, 0, 300) in zip(a, b, n) and (177_000, 301, 3000) in zip(a, b, n)


def test_spread_of_seeds(spark):
    rng = np.random.default_rng(16)
    p = Passages([(k, " ".join(prose(90, rng))) for k in range(3)])
    docs = [(f"g{d % 400}", " ".join([*prose(30, rng), *p.words[0][:40], *(p.words[1] if d % 8 == 0 else [])])) for d in range(800)]
    spread, total = seed_spread(spark.createDataFrame(docs, "g string, text string").repartition(5), "text", "g", p)
    assert abs(total - 400) < 120
    assert abs(np.median(spread[p.seed_of[p.starts[0] : p.starts[0] + 37]]) - 400) < 120
    assert abs(np.median(spread[p.seed_of[p.starts[1] : p.starts[1] + 87]]) - 50) < 15
    assert (spread[p.seed_of[p.starts[2] : p.starts[2] + 87]] == 0).all()


def test_planted_leaks(spark):
    rng = np.random.default_rng(9)
    passages = [prose(90, rng) for _ in range(6)]
    docs, want = [], set()
    for d in range(300):
        parts = [*prose(120, rng), *STOCK.split(), *prose(80, rng)]
        k = d % 20
        if k < 4:
            p = list(passages[d % 6])
            part = [p, p[20:56], p, p[5:70]][k]
            if k == 2:  # single words altered, one lost
                part = [w if i % 9 else w[:-1] + "q" for i, w in enumerate(part) if i != 44]
            text = " ".join(part)
            if k == 3:
                text = text.upper().replace(" ", " \n ", 12)
            parts[150:150] = text.split(" ")
            want.add((d, d % 6))
        elif k == 4:
            parts[150:150] = passages[d % 6][10:22]  # a short quotation
        docs.append((d, " ".join(parts), "hot" if d % 3 == 0 else f"g{d}", 1))
    docs += [(400, None, "a", 1), (401, "", None, 1), (402, " ".join(passages[0]) + " x" * 200_000, None, 1), docs[0]]
    want.add((402, 0))
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(50, " ".join([*prose(50, rng), STOCK])), (51, None), (52, ""), (None, STOCK)]
    df = spark.createDataFrame(docs, "id long, text string, g string, _id int").repartition(3)
    it = spark.createDataFrame(items, "item long, passage string")
    out = leaked_passages(df, it, "id", "text", "item", "passage", "g")
    got = [(r["id"], r["item"]) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    left = without_leaks(df, out, "id")
    assert left.count() == df.count() - len({d for d, _ in want}) - 1  # the repeated row goes too
    assert leaked_passages(df.limit(0), it, "id", "text", "item", "passage", "g").count() == 0
    assert leaked_passages(df.limit(5), it.limit(0), "id", "text", "item", "passage").count() == 0


def test_leaks_with_few_verbatim_seeds(spark):
    rng = np.random.default_rng(11)
    passages = [prose(90, rng) for _ in range(3)]
    altered = lambda part, at: [w[:2] + "z" + w[3:] if i in at else w for i, w in enumerate(part)]
    parts = [
        altered(passages[0][20:50], {4, 9, 14, 19, 24}),  # 25 of 30 words verbatim, 7 whole seeds
        altered(passages[1][30:70], set(range(3, 40, 4)) - {19}),  # 1 run of seven words, 4 whole seeds
        altered(passages[2][10:46], {*range(3, 36, 3)} - {15} | {17}),  # 1 whole seed
    ]
    docs = [(k, " ".join([*prose(60, rng), *p, *prose(60, rng)])) for k, p in enumerate(parts)]
    docs += [(3, " ".join([*prose(60, rng), *passages[0][20:24], *prose(60, rng)]))]
    df = spark.createDataFrame(docs, "id long, text string")
    it = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item long, passage string")
    out = leaked_passages(df, it, "id", "text", "item", "passage").collect()
    assert {(r["id"], r["item"]) for r in out} == {(0, 0), (1, 1), (2, 2)}


def test_leaks_with_replaced_words(spark):
    rng = np.random.default_rng(13)
    passages = [prose(90, rng) for _ in range(3)]
    replaced = lambda part, at: ["qqq" if i in at else w for i, w in enumerate(part)]
    parts = [replaced(passages[0][20:50], {5, 11, 17, 23}), replaced(passages[1], set(range(5, 90, 7))), replaced(passages[2], set(range(2, 90, 3)))]
    df = spark.createDataFrame([(k, " ".join([*prose(60, rng), *p, *prose(60, rng)])) for k, p in enumerate(parts)], "id long, text string")
    it = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item long, passage string")
    out = leaked_passages(df, it, "id", "text", "item", "passage").collect()
    assert {(r["id"], r["item"]) for r in out} == {(0, 0), (1, 1)}  # every third word replaced is no longer that part


def test_copies_under_many_groups_are_no_stock(spark):
    rng = np.random.default_rng(14)
    passage = prose(60, rng)
    copy = " ".join([*prose(40, rng), *passage, *prose(40, rng)])
    docs = [(k, copy if k < 60 else " ".join([*prose(80, rng), *STOCK.split()]), f"g{k}") for k in range(200)]
    df = spark.createDataFrame(docs, "id long, text string, g string").repartition(3)
    it = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join([*prose(50, rng), STOCK]))], "item long, passage string")
    out = leaked_passages(df, it, "id", "text", "item", "passage", "g").collect()
    assert {(r["id"], r["item"]) for r in out} == {(k, 1) for k in range(60)}


def test_passages_in_very_many_rulings(spark):
    rng = np.random.default_rng(17)
    passages = [prose(90, rng), [*prose(40, rng), *STOCK.split(), *prose(40, rng)]]
    docs = [(k, " ".join([*prose(60, rng), *(passages[k % 2] if k < 60 else []), *prose(60, rng), *STOCK.split()]), f"g{k}") for k in range(100)]
    df = spark.createDataFrame(docs, "id long, text string, g string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item long, passage string")
    out = leaked_passages(df, it, "id", "text", "item", "passage", "g").collect()
    assert {(r["id"], r["item"]) for r in out} == {(k, k % 2) for k in range(60)}
    assert {(r["item"], r["verbatim"]) for r in out} == {(0, 90), (1, 120)}


def test_parts_with_changed_letters_are_found(spark):
    rng = np.random.default_rng(18)
    passages = [prose(90, rng) for _ in range(4)]
    docs = []
    for k in range(20):
        part = [w[:3] + "z" + w[4:] if i % 5 == 2 else w for i, w in enumerate(passages[k % 4][2 * k : 2 * k + 35])]
        docs.append((k, " ".join([*prose(60, rng), *part, *prose(60, rng)])))
    df = spark.createDataFrame(docs, "id long, text string").repartition(2)
    it = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item long, passage string")
    out = leaked_passages(df, it, "id", "text", "item", "passage").collect()
    assert {(r["id"], r["item"]) for r in out} == {(k, k % 4) for k in range(20)}


def test_reach_and_bands_bound_the_alignment():
    rng = np.random.default_rng(12)
    few = [*LEXICON[:3], LEXICON[0][:-1] + "z", "ab", LEXICON[5]]
    p = Passages([(i, " ".join(rng.choice(few, 40))) for i in range(3)])
    texts = [[str(w) for w in rng.choice(few, 70)] for _ in range(12)]
    shard = Shard([" ".join(t) for t in texts])
    a, b, n = matches(shard.ids(p), p, p.seed_of >= 0)
    shapes = WordShapes()
    numbers = np.append(np.concatenate([np.append(shapes.number(w), [0] * 4) for w in p.words]), [0] * 4)
    there = shard.laid_out(shapes.number(shard.words))
    (before, n_before), (after, n_after) = reach(shapes, numbers, there, a - 1, b - 1, -1), reach(shapes, numbers, there, a + n, b + n, 1)
    text, start = b // 74, p.starts[p.item[a]]
    for k in range(len(a)):
        begin, end, hit = align(p.words[p.item[a[k]]], texts[text[k]], a[k : k + 1] - start[k], b[k : k + 1] % 74, n[k : k + 1])
        assert (begin, end - 1, hit.sum()) == (before[k] - start[k], after[k] - start[k], n_before[k] + n[k] + n_after[k])
    pair = text * 3 + p.item[a]
    order, first = bands(pair, a, b, n, gap=5, drift=2)
    band = np.zeros(len(a), dtype=np.int64)
    band[order] = np.cumsum(np.isin(np.arange(len(a)), first)) - 1
    begins, lasts = np.minimum.reduceat(before[order], first), np.maximum.reduceat(after[order], first)
    assert len(a) > len(first) > len(set(pair.tolist()))
    for q in set(pair.tolist()):
        of = np.flatnonzero(pair == q)
        begin, end, _ = align(p.words[q % 3], texts[q // 3], a[of] - p.starts[q % 3], b[of] % 74, n[of], gap=5, drift=2)
        assert any(begins[k] <= begin + p.starts[q % 3] and end - 1 + p.starts[q % 3] <= lasts[k] for k in set(band[of].tolist()))


# subjects --------------------------------------------------------------------------------------------------------


def test_sentences_and_parts():
    s, part = sentences("IN THE COURT\n\nBetween A and B.\n\nJUDGMENT\n\n[1] The wall fell on F. Smith in May. It was wet.\n\nAm 17. Oktober kam er.\n\nORDER\n\nThe appeal is dismissed.")
    assert s == ["in the court", "between a and b.", "[1] the wall fell on f. smith in may.", "it was wet.", "am 17. oktober kam er.", "the appeal is dismissed."]
    assert part == [0, 0, 1, 1, 1, 2] and sentences(None) == ([], [])


def test_held_out_mixtures(spark, data):
    rows = spark.read.parquet(f"{data}/subject_examples.parquet").where("subject_code is not null").select("text", "subject_code").distinct().orderBy("text").collect()
    docs = [r[0] for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("text").where("text is not null").orderBy("doc_id").collect()]
    fit, held = [tuple(r) for i, r in enumerate(rows) if i % 4], [tuple(r) for i, r in enumerate(rows) if not i % 4]
    model = fit_subjects(fit, docs)
    talk = "The clerk is directed to notify the parties and to close the file."
    rng = np.random.default_rng(10)
    texts, truth = [], []
    by = {}
    for t, c in held:
        by.setdefault(c, []).append(t)
    codes = sorted(by)
    for k in range(60):
        a, b = rng.choice(len(codes), 2, replace=False)
        pick = [*rng.choice(by[codes[a]], 3), *(rng.choice(by[codes[b]], 3) if k % 2 else [])]
        texts.append(f"JUDGMENT\n\n{' '.join(pick)} {talk}")
        truth.append({codes[a], codes[b]} if k % 2 else {codes[a]})
    n = subject_counts(model, texts, WordHashes())
    share = n[:, :-1] / np.maximum(n[:, -1:], 1)
    got = [{model.codes[j] for j in np.flatnonzero(s >= 0.2)} for s in share]
    hits, said, there = sum(len(g & t) for g, t in zip(got, truth)), sum(map(len, got)), sum(map(len, truth))
    assert hits / said > 0.8 and hits / there > 0.85


def test_many_examples_leave_room_for_rulings():
    rng = np.random.default_rng(15)
    examples = [(f"The {LEXICON[a]} was {LEXICON[b]} there. It met {LEXICON[c]} too.", "xy"[k % 2]) for k, (a, b, c) in enumerate(rng.integers(0, 60, (6100, 3)) + 60 * (np.arange(6100) % 2)[:, None])]
    rulings = ["IN THE COURT\n\nBetween A and B.\n\nJUDGMENT\n\nThe clerk saw the wall. It was wet.\n\nORDER\n\nThe appeal is dismissed."] * 20
    with_rulings, without = fit_subjects(examples, rulings, rounds=5), fit_subjects(examples, [], rounds=5)
    assert (with_rulings.weights != without.weights).any()
    few = fit_subjects(examples, rulings, rounds=5, max_example_sentences=400, max_ruling_sentences=0)
    assert (few.weights == fit_subjects(examples[:200], [], rounds=5).weights).all()


def test_subject_edges(spark, data):
    ex = spark.read.parquet(f"{data}/subject_examples.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "docket_no").limit(60)
    more = spark.createDataFrame([(-1, None, None), (-2, "", None), (None, "JUDGMENT\n\nword", None)], docs.schema)
    df = docs.unionByName(more).withColumn("_id", F.lit(1)).withColumn("subject_code", F.lit("z"))
    out = subject_areas(df, ex, "doc_id", "text", "text", "subject_code", "docket_no", max_rulings=50).collect()
    assert out and all(r["share"] >= 0.2 and r["doc_id"] not in (-1, -2) for r in out)
    assert subject_areas(df, ex.limit(0), "doc_id", "text", "text", "subject_code").count() == 0
    assert subject_areas(df.limit(0), ex, "doc_id", "text", "text", "subject_code").count() == 0
