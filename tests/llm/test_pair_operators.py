"""Operators on pairs and spans: Jaccard join, sentence spans, test items, components."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import components, decontamination, ngram_jaccard, sentence_spans

DOCS = "doc_id long, text string, n string, rep string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS).repartition(3)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def corpus(seed=1, groups=8):
    """Random texts with chains of edited copies, exact copies, short texts and a common passage."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    common = [word() for _ in range(30)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice((5, 9, 20, 60, 150)))]
        if g % 3 == 0:
            base = base + common
        for c in range(rnd.randrange(1, 7)):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(max(0, len(base) // 60 + (c % 2))):
                base[rnd.randrange(len(base))] = word()
    out += ["", "  ", None, "a", "A", "a b c", "A  b\nC", "one two three four", "one two three FOUR"]
    rows = list(enumerate(out))
    rnd.shuffle(rows)
    return rows + [rows[0], (None, "a b c")]


def brute(rows, n, num):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= num * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n,num,seed", [(4, 85, 1), (5, 80, 2)])
def test_join_matches_brute_force(spark, n, num, seed):
    rows = corpus(seed)
    got = ngram_jaccard.join(table(spark, rows), n, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, num)


@pytest.mark.parametrize("hot", [ngram_jaccard.HOT, 25])
def test_join_of_many_copies_near_the_threshold(spark, hot):
    """Hundreds of copies that share rare n-grams, many just below the threshold; also with hot lists split."""
    rnd = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 5, 6))):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t[rnd.randrange(12) :])))
    rows += [(1000 + i, " ".join(f"y{i}_{j}" for j in range(rnd.randrange(20, 40))) + " " + " ".join(base[:14])) for i in range(60)]
    rows.append((5000, " ".join(f"z{i % 4000}" for i in range(60_000))))
    rows.append((5001, " ".join(f"z{i % 4000}" for i in range(60_000)) + " end"))
    got = ngram_jaccard.join(table(spark, rows), hot=hot).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)


def test_marks_never_rule_out_a_link():
    rnd = np.random.default_rng(3)
    for size in (2, 20, 63, 64, 65, 700, 5000):
        s = np.unique(rnd.integers(0, 2**64, size, np.uint64))
        for drop, add in ((0, 0), (1, 0), (size // 10, size // 12), (size // 3, size), (0, 3 * size)):
            t = np.unique(np.concatenate([s[drop:], rnd.integers(0, 2**64, add, np.uint64)]))
            apart = len(np.setxor1d(s, t))
            d = ngram_jaccard.differ(ngram_jaccard.marks(s), ngram_jaccard.marks(t))
            assert d <= apart and (apart - d) % 2 == 0 and (apart > 1 or d == apart)


def test_join_reads_whole_sets_for_likely_links_only(spark, monkeypatch):
    """Documents put together from shared passages meet in the lists; only those that may link are read whole."""
    passage = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(12)]
    rows = [(i * 12 + j, f"{passage[i]} {passage[j]}") for i in range(12) for j in range(i)]
    rows.append((900, rows[5][1] + " end"))
    whole, cut = [], ngram_jaccard.Scratch.cut

    def counted(self, df):
        out = cut(self, df)
        whole.extend([out.count()] if "grams" in out.columns else [])
        return out

    monkeypatch.setattr(ngram_jaccard.Scratch, "cut", counted)
    got = ngram_jaccard.join(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)
    assert 2 <= sum(whole) <= 10


def test_join_meets_the_text_that_copies_were_made_from(spark, monkeypatch):
    """Copies of one text join through it, so next to none is left to meet the whole group in the second pass."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 800):
        t = list(base)
        for _ in range(rnd.choice((1, 2, 3))):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    pairs, cut = [], ngram_jaccard.Scratch.cut

    def counted(self, df):
        out = cut(self, df)
        pairs.extend([out.where("u <> v").count()] if out.columns == ["u", "v", "c"] else [])
        return out

    monkeypatch.setattr(ngram_jaccard.Scratch, "cut", counted)
    got = ngram_jaccard.join(table(spark, rows), 5, 80, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 5, 80)
    assert sum(pairs[-2:]) <= len(rows) // 10


def test_join_raises_below_one_half(spark):
    with pytest.raises(ValueError):
        ngram_jaccard.join(table(spark, []), num=50)


def test_join_empty(spark):
    assert ngram_jaccard.join(table(spark, [])).count() == 0


def test_boundary_weighs_costs():
    assert ngram_jaccard.boundary_of([(5, 10, 1000.0), (50, 10, 100.0)], 85, 100) == 5
    assert ngram_jaccard.boundary_of([(50, 10, 1.0)], 85, 100) < 50


def test_components_agree(spark):
    rnd = random.Random(2)
    links = spark.createDataFrame([(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)], "u long, v long")
    a = sorted(map(tuple, components.components(links).collect()))
    assert a == sorted(map(tuple, components.components(links, task_links=0).collect())) and a


def spans_by_hand(rows, least):
    """Sentences and removed ones of each id."""
    docs = {}
    for d, t in rows:
        out = []
        for line in (t or "").split("\n"):
            cur = []
            for w in words(line):
                cur.append(w)
                if w[-1] in ".!?":
                    out.append(cur)
                    cur = []
            if cur:
                out.append(cur)
        docs[d] = out
    first, gone = {}, {d: set() for d in docs}
    for d in sorted(docs, key=lambda d: (d is None, d)):
        s, runs = docs[d], set()
        for a in range(len(s)):
            for b in range(a, len(s)):
                if sum(map(len, s[a : b + 1])) >= least:
                    runs.add((a, b + 1))
                    break
            for b in range(a, -1, -1):
                if sum(map(len, s[b : a + 1])) >= least:
                    runs.add((b, a + 1))
                    break
        for a, b in sorted(runs):
            key = tuple(w for x in s[a:b] for w in x)
            if first.setdefault(key, (d, a)) != (d, a):
                gone[d] |= set(range(a, b))
    return docs, gone


def test_spans(spark):
    rnd = random.Random(4)
    sentence = lambda: " ".join(f"t{rnd.randrange(900)}" for _ in range(rnd.randrange(1, 14))) + rnd.choice(".!?")
    passage = "  ".join(sentence() for _ in range(8))
    rows = []
    for i in range(40):
        parts = [sentence() for _ in range(rnd.randrange(0, 9))]
        if i % 3 == 0:
            parts.insert(rnd.randrange(len(parts) + 1), "\n" + passage + "\n")
        rows.append((i, " ".join(parts)))
    rows += [(50, None), (51, ""), (52, " \n "), (53, passage), (53, passage), (None, passage)]
    long = " ".join(f"l{i}" + "." * (i % 17 == 0) for i in range(150_000))
    rows += [(60, long + ". tail"), (61, "head. " + long)]
    docs, gone = spans_by_hand(rows, 20)
    got = sentence_spans.dedup(table(spark, rows), 20).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_sentences, r.n_removed) == (len(docs[r.doc_id]), len(gone[r.doc_id]))
        assert words(r.text) == [w for k, s in enumerate(docs[r.doc_id]) if k not in gone[r.doc_id] for w in s]
    text = dict(rows)
    assert all(r.text == text[r.doc_id] for r in got if not r.n_removed)
    assert gone[3] and not gone[0] and len(gone[None]) == len(docs[None])
    assert sentence_spans.dedup(table(spark, []), 20).count() == 0


def alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
        score, s, e = decontamination.smith_waterman(a, b)
        assert score == alignment(a.tolist(), b.tolist())
        if score:
            assert alignment(a.tolist(), b[s:e].tolist()) == score


def test_decontamination(spark):
    rnd = random.Random(5)
    word = lambda: f"q{rnd.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(40))) for k in range(6)] + [(90, None), (91, ""), (92, "two words")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(120)]
        if i % 5 == 0:
            own = items[i % 6][1].split()
            for _ in range(i % 4):
                own[rnd.randrange(40)] = word()
            if i % 10 == 0:
                own.insert(10, word())
            w[50:50] = own
        docs.append((i, " ".join(w).upper() if i % 2 else ", ".join(w)))
    docs += [(70, None), (71, ""), (72, items[0][1]), (72, items[0][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t in docs:
        b = re.findall("[a-z0-9]+", (t or "").lower())
        for k, x in items[:6]:
            a = x.split()
            if b and alignment(a, b) / (2 * len(a)) >= 0.5:
                want[d, k] += 1
    for words_a_block in (1 << 22, 60):
        got = decontamination.contaminated(table(spark, docs), bench, block_words=words_a_block).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == want
    assert len(want) >= 14
    assert decontamination.contaminated(table(spark, []), bench).count() == 0
    assert decontamination.contaminated(table(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_finds_heavily_edited_copies(spark):
    """Every third to sixth word replaced, words put in between, halves: as brute force over all pairs."""
    rnd = random.Random(6)
    word = lambda: f"q{int(400 * rnd.random() ** 2)}"
    items = [(k, " ".join(word() for _ in range(rnd.randrange(20, 60)))) for k in range(8)]
    docs = []
    for k, text in items:
        own = text.split()
        edited = [[word() if i % step == 1 else x for i, x in enumerate(own)] for step in (3, 4, 5, 6)]
        edited += [[y for i, x in enumerate(own) for y in ((x, word()) if i % step == 0 else (x,))] for step in (1, 2, 3)]
        edited += [own, own[: -(-len(own) // 2)], own[: len(own) // 2 - 1], own[::-1]]
        for e in edited:
            docs.append((len(docs), " ".join([*(word() for _ in range(70)), *e, *(word() for _ in range(70))])))
    want = set()
    for d, t in docs:
        for k, x in items:
            if alignment(x.split(), t.split()) / (2 * len(x.split())) >= 0.5:
                want.add((d, k))
    got = decontamination.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(want) >= 8 * 6


def test_decontamination_finds_short_items(spark):
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "delta epsilon zeta"), (4, "eta theta iota kappa"), (5, "..."), (6, "")]
    docs = [(1, "an alpha here"), (2, "x beta, gamma y"), (3, "delta epsilon zeta"), (4, "x eta theta iota kappa"), (5, "beta x gamma, delta epsilon, eta theta iota"), (6, "...")]
    got = decontamination.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(k, k, 1.0) for k in range(1, 5)}
