"""Operators over documents against brute force on a small corpus."""
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paramforge.llm import chosen_path, interpolated_lm, license_alignment, piece_viterbi, robust_quality, rule_classifier, simhash_decontam, suffix_dedup, token_store
from paramforge.llm.queries import tokenizer_path
from paramforge.llm.textstats import STATS, text_stats

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


# 1
def brute_stats(text):
    text = text or ""
    w = split(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen and split(line):
            dup += 1
        seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(w), sum(c not in SPACE for c in text), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_statistics(corpus):
    for _, t in corpus:
        assert text_stats(t)[:5] == brute_stats(t)


def test_quality_report(docs, empty, corpus):
    rows = robust_quality.quality_report(docs, robust_quality.Params(min_rows=10)).collect()
    assert len(rows) == docs.count()
    texts = dict(corpus)
    for r in rows:
        if r.doc_id is None:
            continue
        n, chars, symbols, dup, rep = brute_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    kept = robust_quality.keep_good(docs, robust_quality.Params(min_rows=10))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert robust_quality.quality_report(empty).count() == 0


def test_determinant_falls_and_outliers_go(spark):
    rng = np.random.default_rng(3)
    text = lambda k, junk: "\n".join(" ".join("abcdefgh"[: rng.integers(2, 8)] + str(k) + str(j) + str(i) for i in range(12)) + ("###" * 12 if junk else "") for j in range(8))
    rows = [(k, text(k, k % 10 == 0), "en", "s") for k in range(150)]
    got = robust_quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {k for k in range(150) if k % 10 == 0}


# 2
def test_licence_with_long_insertions():
    """Against the alignment of whole texts."""
    foreign = lambda n, k: " ".join(f"zz{k}q{i}" for i in range(n))
    scanner = license_alignment.Scanner(license_alignment.TEMPLATES, license_alignment.Params())
    tried = 0
    for name, text in license_alignment.TEMPLATES.items():
        w = text.split()
        template = license_alignment.word_list(text)
        for n in (8, 9, 30, 300):
            for at in ([len(w) // 2], [len(w) // 3, 2 * len(w) // 3]):
                if len(w) < 12:
                    continue
                cuts = [0, *at, len(w)]
                notice = f" {foreign(n, 1)} ".join(" ".join(w[a:b]) for a, b in zip(cuts, cuts[1:]))
                for copies in (1, 2):
                    body = f" {foreign(50, 2)} ".join([notice] * copies)
                    got = [f for f in scanner.scan(f"{foreign(20, 3)} {body} {foreign(20, 4)}") if f[0] == name]
                    whole = license_alignment.align(license_alignment.word_list(notice), template)
                    assert [f[2] for f in got] == [len(whole)] * copies and len(whole) == len(template), (name, n, at, copies)
                    tried += 1
    assert tried and not scanner.scan(f"released {foreign(40, 1)} under {foreign(40, 2)} the {foreign(40, 3)} license")


# 3
@pytest.mark.parametrize("hot", [2, 5000])
def test_suffix_dedup(docs, empty, corpus, hot):
    p = suffix_dedup.Params(hot_rows=hot, piece=1000)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_report(docs, p).collect()}
    seen = set()
    for i, t in sorted(corpus):
        b = (t or "").encode()
        gone = bytearray(len(b))
        strings = [b[j : j + 50] for j in range(len(b) - 49)]
        for j, w in enumerate(strings):
            if w in seen:
                gone[j : j + 50] = b"\1" * 50
        seen.update(strings)
        left = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b)))
        assert got[i] == (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()), i
    assert suffix_dedup.removed_report(empty, p).count() == 0


def test_suffix_dedup_hot_phrase(spark):
    """A phrase in all documents, mostly with other surroundings: one string
    of it meets only its equals."""
    rng = np.random.default_rng(2)
    noise = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 60))
    phrase, tail = "THIS PHRASE IS IN EACH TEXT ", "AND THIS TAIL IS IN EVERY TENTH OF THEM ALL"
    texts = [noise() + phrase + (tail if d % 10 == 0 else "") + noise() for d in range(200)]
    p = suffix_dedup.Params(hot_rows=20)
    hits = [{"name": n, "salts": 10} for n in shared_names(texts, p)]
    kind = pa.schema([("doc", pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.struct([("name", pa.int64()), ("salts", pa.int32())])))])
    rows = list(suffix_dedup.suffix_rows(iter([pa.RecordBatch.from_pylist([{"doc": d, "text": t, "hits": hits} for d, t in enumerate(texts)], schema=kind)]), p))
    keys = [k for b in suffix_dedup.keyed(iter(rows), p) for k in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist())]
    assert len(keys) > 2000 and max(collections.Counter(keys).values()) <= 20
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.removed_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p).collect()}
    seen, cut = set(), 0
    for d, t in enumerate(texts):
        gone, strings = set(), [t[j : j + 50] for j in range(len(t) - 49)]
        for j, w in enumerate(strings):
            if w in seen:
                gone.update(range(j, j + 50))
        seen.update(strings)
        cut += bool(gone)
        assert got[d] == hashlib.sha256("".join(c for j, c in enumerate(t) if j not in gone).encode()).hexdigest(), d
    assert cut >= 19


def shared_names(texts, p):
    batch = pa.RecordBatch.from_pylist([{"doc": d, "text": t} for d, t in enumerate(texts)])
    names = [n for b in suffix_dedup.sample_names(iter([batch]), p) for n in b.column("name").to_pylist()]
    return [n for n, c in collections.Counter(names).items() if c > 1]


def test_suffix_dedup_stage(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.text is None or r.n_chars is None or r.n_chars == len(r.text) for r in out.collect())


# 4
def test_chosen_path(docs, empty, corpus):
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := split(t)) else set()
    sets = {i: grams(t) for i, t in corpus}
    first = {}
    for i, t in corpus:
        first.setdefault(t, i)
    reps = sorted(i for i, t in corpus if sets[i] and first[t] == i)
    links, root = collections.Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in reps:
        for b in reps:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    for p in (chosen_path.Params(), chosen_path.Params(leaf_rows=2)):
        got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in chosen_path.near_duplicates(docs, p).collect()}
        for i, t in corpus:
            rep = first[t] if sets[i] else i
            assert got[i] == (find(rep), rep, links[rep]), i
    assert sum(links.values()) and chosen_path.near_duplicates(empty).count() == 0


def test_chosen_path_repeated_rows(docs):
    """Every row twice, as in the union of two crawls: the same links."""
    key = lambda r: (str(r.doc_id), r.class_id, r.copy_of, r.n_links)
    for p in (chosen_path.Params(), chosen_path.Params(leaf_rows=2)):
        once = {key(r) for r in chosen_path.near_duplicates(docs, p).collect()}
        twice = chosen_path.near_duplicates(docs.unionByName(docs), p).collect()
        assert {key(r) for r in twice} == once and len(twice) == 2 * docs.count()
    assert sum(n > 0 for *_, n in once) > 4


def test_chosen_path_two_texts_under_one_doc_id(spark, corpus):
    """Each text of the doc_id has its own links; none is lost."""
    base = [t for _, t in corpus[9:39]][:8]
    near = [t + " and more" for t in base]
    rows = [(1, base[0]), (1, base[1]), (1, base[1]), (2, near[0]), (3, near[1]), (4, base[2]), (4, near[2]), (5, base[3]), (5, base[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in chosen_path.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, 1)] * 3 + [(2, 1, 1 + 1, 1), (3, 1, 3, 1), (4, 4, 4, 1), (4, 4, 4, 1), (5, 5, 5, 0), (5, 5, 5, 0)]
    kept = chosen_path.representatives(docs)
    assert sorted(r.doc_id for r in kept.collect())[-2:] == [5, 5] and kept.count() == 5


def test_chosen_path_large_groups_and_recall(spark):
    """Thousands of links, in leaves cut into blocks: none is lost, and none
    is counted twice."""
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]
    rows, sets = [], []
    for group in range(12):
        base = words(120)
        for k in range(60 if group < 2 else 6):
            t = list(base)
            t[rng.randrange(120)] = f"changed{rng.randrange(9)}"
            rows.append(" ".join(t))
    rows = sorted(set(rows)) + [" ".join(words(60)) for _ in range(200)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    want = [sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(len(sets))) for a in range(len(sets))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for p in (chosen_path.Params(), chosen_path.Params(leaf_rows=10, block_rows=15)):
        got = {r.doc_id: r.n_links for r in chosen_path.near_duplicates(docs, p).collect()}
        assert [got[k] for k in range(len(rows))] == want
    assert sum(want) > 2000


# 5
def test_pieces(docs, empty, corpus):
    model = tokenizer_path("piece_bpe_32k.model")
    v = piece_viterbi.Vocabulary.load(open(model, "rb").read())
    scores = {p: v.ends[p] for p in v.raw}

    def brute(word):
        best = [(0.0, 0, ())]
        for e in range(1, len(word) + 1):
            options = [(best[s][0] + scores[word[s:e]], -s, best[s][2] + (word[s:e],)) for s in range(e) if word[s:e] in scores]
            best.append(max(options, key=lambda o: o[:2]))
        return b"".join(v.raw[p] for p in best[-1][2])

    words = sorted({w for _, t in corpus for w in piece_viterbi.marked_words(t or "") if all(c in scores for c in w) and len(w) < 40})
    for word, ids in piece_viterbi.segment_sorted(words, v):
        assert ids == brute(word), word
    rows = piece_viterbi.pieces_of(docs, model)
    texts = dict(corpus)
    for r in rows.collect():
        t = texts.get(r.doc_id) if r.doc_id is not None else ""
        assert r.round_trip == ("▁" not in (t or "")) and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in piece_viterbi.texts_of(rows, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in corpus)
    assert piece_viterbi.pieces_of(empty, model).count() == 0


# 6
def test_simhash_decontamination(spark, docs, empty, corpus):
    texts = dict(corpus)
    long = texts[20].split()
    items = [(1, " ".join(long[5:30])), (2, " ".join(w if k != 1 else "other" for k, w in enumerate(texts[25].split()[2:40]))), (3, "nothing of this is there at all"), (4, None), (5, ""), (6, "two words"), (1, " ".join(long[5:30]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    low = lambda t: [w.decode().lower() for w in split(t)]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    lists = {i: low(t) for i, t in items if split(t)}
    df = collections.Counter(g for w in lists.values() for g in set(grams(w)))
    weight = lambda g: 1 + round(4 * math.log(len(lists) / df.get(g, 1)))
    expected = {}
    for d, t in corpus:
        w = low(t)
        for i, item in lists.items():
            for s in range(len(w) - len(item) + 1):
                a, b = collections.Counter(grams(w[s : s + len(item)])), collections.Counter(grams(item))
                if not any(x == y for x, y in zip(grams(w[s : s + len(item)]), grams(item))):
                    continue
                sim = sum(weight(g) * min(a[g], b[g]) for g in a | b) / sum(weight(g) * max(a[g], b[g]) for g in a | b)
                if sim >= 0.8 and (sim, -s) > expected.get((d, i), (0, 0)):
                    expected[d, i] = (sim, -s)
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in simhash_decontam.matches(docs, table).collect()}
    assert got.keys() == expected.keys() and len(got) > 2
    assert all(abs(got[k][0] - expected[k][0]) < 1e-5 and got[k][1] == expected[k][1] for k in got)
    rest = simhash_decontam.without_leaks(docs, table)
    assert rest.columns == docs.columns and {r.doc_id for r in rest.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    assert simhash_decontam.matches(empty, table).count() == 0 and simhash_decontam.matches(docs, table.limit(0)).count() == 0


def test_simhash_all_windows(spark):
    """Against all windows: items that run over the edges of a text, texts
    shorter than the item, words put into the middle."""
    word = lambda d, i: f"w{d}x{i}"
    lists = {d: [word(d, i) for i in range(55)] for d in range(6)}
    other = [word(9, i) for i in range(200)]
    texts = {
        0: lists[0][2:] + other[:60],  # without its first two words, at the start of the text
        1: other[:60] + lists[1][:-2],  # without its last two, at the end
        2: lists[2][:-1],  # the whole text lacks a word of the item
        3: other[:30] + lists[3][:28] + other[90:92] + lists[3][28:] + other[100:130],
        4: lists[4][:20],  # too little
        5: other[:7] + lists[5] + other[7:9],
        6: lists[2][1:-1] + lists[5][3:],
    }
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()] * 2, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in lists.items()], "item_id long, text string")
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    weight = 1 + round(4 * math.log(len(lists)))  # no shingle is in two items
    expected = {}
    for d, w in texts.items():
        for i, item in lists.items():
            for s in range(max(1, len(w) - len(item) + 1)):
                a, b = collections.Counter(grams(w[s : s + len(item)])), collections.Counter(grams(item))
                sim = weight * sum((a & b).values()) / (weight * sum((a | b).values()))
                if sim >= 0.8 and (sim, -s) > expected.get((d, i), (0, 0)):
                    expected[d, i] = (sim, -s)
    assert {(0, 0), (1, 1), (2, 2), (5, 5)} <= expected.keys()
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in simhash_decontam.matches(docs, items).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k][0] - expected[k][0]) < 1e-5 and got[k][1] == expected[k][1] for k in got)


# 7
def test_rule_classifier(spark, empty):
    rows = [(k, (f"good words {k} are here and there and so on " * 6) if k % 3 else ("BAD!! " * 40 + str(k))) for k in range(120)] + [(None, None), (500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(120)] + [(1, None), (7, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rule_classifier.scored(docs, labels).collect()}
    assert len(got) == len(rows)
    for k in range(120):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and got[k].predicted == int(k % 3 > 0) == int(got[k].score >= 0.3)
    one = rule_classifier.scored(docs, labels.where("quality = 1")).collect()
    assert all(0.9 < r.score < 1 for r in one) and rule_classifier.scored(empty, labels).count() == 0


# 9
def test_interpolated_scores(docs, empty, corpus):
    p = interpolated_lm.Params(chunk_bytes=4000)
    got = [r for r in interpolated_lm.scores(docs, p).collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = [(i, (t or "").encode().lower().split() + [b"\0"]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count, pair, n_docs = collections.Counter(), collections.Counter(), 0
    for i, w in tokens:
        if not held(i):
            n_docs += 1
            count.update(w)
            pair.update(zip([b"\1"] + w, w))
    n, v = sum(count.values()), len(count)

    def parts(w, less):
        for a, b in zip([b"\1"] + w, w):
            c1 = (n_docs if a == b"\1" else count[a]) - less
            bucket = min(math.ceil(math.log2(max(c1, 0) + 1)), p.buckets - 1)
            yield bucket, max(pair[a, b] - less, 0) / c1 if c1 > 0 else 0.0, max(count[b] - less, 0) / max(1, n - less)

    table = collections.Counter(x for i, w in tokens if not held(i) for x in parts(w, 1))
    weights = interpolated_lm.expectation_maximisation([(*k, m) for k, m in table.items()], v, p)
    want = {i: w for i, w in tokens}
    for r in got:
        w = want[r.doc_id]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        model = sum(math.log10(weights[b] @ (p2, p1, 1 / (v + 1))) for b, p2, p1 in parts(w, 0))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(model, rel=2e-3)
    assert len(got) == len(rows) and interpolated_lm.scores(empty).count() == 0


# 10
def test_token_store(docs, empty, corpus):
    from tokenizers import Tokenizer

    p = token_store.Params(tokenizer_path("byte_bpe_50k.json"), block_bytes=300)
    tok = Tokenizer.from_file(p.tokenizer)
    got = sorted((tuple(r) for r in token_store.stored_report(docs, p).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: -1 if x is None else x)
    start, texts = 0, {r.doc_id: r.text for r in docs.collect()}
    for doc, at, n, crc in got:
        ids = tok.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += n
    assert token_store.stored_report(empty, p).count() == 0


# 2
def test_licence_alignment(spark, empty):
    mit = license_alignment.TEMPLATES["MIT"]
    edited = mit.replace("free of charge,", "free of any charge").replace("Software", "Program", 1)
    rows = [(1, "before " + mit + " after"), (2, f"{edited} middle words are here {mit}"), (3, "the software is good and free"), (4, None), (5, ""), (6, "Released under the MIT License."), (7, "x " * 5000 + "released UNDER the mit license")]
    got = {r.doc_id: r for r in license_alignment.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].licence == "MIT" and got[1].coverage == 1.0 and (got[1].start_word, got[1].end_word) == (1, 1 + len(mit.split()))
    assert [f.licence for f in got[2].found] == ["MIT", "MIT"] and got[2].found[0].coverage > 0.9 and got[2].found[1].coverage == 1.0
    assert got[3].licence is None and got[4].n_found == 0 and got[5].n_found == 0
    assert got[6].licence == got[7].licence == "MIT-line" and got[7].start_word == 5000
    assert license_alignment.licences(empty).count() == 0
    assert license_alignment.align(list("abcdxyz"), list("abzcdz")) == [(0, 0), (1, 1), (2, 3), (3, 4), (6, 5)]


def test_alignment_never_beats_the_longest_common_subsequence():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = license_alignment.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(got) <= best[-1][-1]


def test_statistics_names():
    assert len(STATS) == len(text_stats("a"))
