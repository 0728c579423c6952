"""Tokenizer spans, packing and conversation repair against plain versions."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paramforge.llm import conversation_repair, packing, tokenizer_alignment

BYTE, PIECE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))

ODD = ["a", " a", "a ", " ", "a  b\n\tcé 漢字🙂 x", "a ▁ b", "a▁b c", "<|endoftext|> x <s> <0x41>", "it's\x00 d e", "word\nnext  \n\n x y", "é" * 50 + " 漢字", "🙂🙂 ok 𝒳", "x" * 3000]


def tokens(spec, text, plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(spec)
    tok.encode_special_tokens = plain
    return tok.encode(text, add_special_tokens=False).ids


# --- tokenizer spans -------------------------------------------------------


def plain_alignment(texts):
    """Rows by a walk over the token bytes, one token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    out, count = [], {}
    for text in texts:
        raw = b" " + (text or "").encode()
        a, b = [], []
        if text:
            signs = tokenizer_alignment.byte_of_sign()
            a = [(i, bytes(signs[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
        groups, links, i, j, ends = [], [], 0, 0, [0, 0]
        ga, gb = [], []
        while i < len(a):
            if not ga or ga[-1][0] != i:
                ga.append((i, a[i][0]))
            if not gb or gb[-1][0] != j:
                gb.append((j, b[j][0]))
            links.append((a[i][0], b[j][0]))
            ea, eb = ends[0] + len(a[i][1]), ends[1] + len(b[j][1])
            if ea <= eb:
                i, ends[0] = i + 1, ea
            if eb <= ea:
                j, ends[1] = j + 1, eb
            if ea == eb:
                groups.append(",".join(str(x) for _, x in ga) + "|" + ",".join(str(x) for _, x in gb))
                ga, gb = [], []
        for x in links:
            count[x] = count.get(x, 0) + 1
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(a, b, g, len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), sha) for a, b, g, k, sha in out]


@pytest.mark.parametrize("chunk", [1, 20_000, 16 << 20])
def test_alignment_equals_a_walk_over_bytes(spark, corpus, chunk):
    rows = [*corpus, *[(1000 + k, t) for k, t in enumerate(ODD)], (None, "null id"), (1000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("units", F.lit(1)).withColumn("chunk", F.lit("x"))
    p = tokenizer_alignment.Params(BYTE, PIECE, chunk_bytes=chunk, cache_bytes=20_000)
    got = [tuple(r)[1:] + (r[0],) for r in tokenizer_alignment.alignment_report(docs, p).collect()]
    want = [(*w, i) for w, (i, _) in zip(plain_alignment([t for _, t in rows]), rows, strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[0] == 0 for w in want) and any(w[4] < w[3] for w in want)


def test_alignment_spans_are_token_bytes(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(99, None)], "doc_id long, text string")
    al = tokenizer_alignment.Aligner(open(BYTE).read(), open(PIECE, "rb").read(), 1 << 20)
    for r in tokenizer_alignment.alignments(docs, tokenizer_alignment.Params(BYTE, PIECE)).collect():
        assert r.a_ends == np.cumsum([len(al.a_bytes[i]) for i in r.a]).tolist()
        assert r.b_ends == np.cumsum([len(al.b_bytes[i]) for i in r.b]).tolist()
        assert len(r.groups.split(";")) == len(set(r.a_ends) & set(r.b_ends)) or not r.a


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenizer_alignment.alignment_report(docs, tokenizer_alignment.Params(BYTE, PIECE)).count() == 0


# --- packing ---------------------------------------------------------------


def test_best_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        at = np.array([0, *sorted(rng.sample(range(1, 70), rng.randint(20, 40))), 70])
        cost = np.array([0, *[rng.choice([0, 2, 5]) for _ in at[1:-1]], 0])
        window = 16
        gaps = np.diff(at).max()
        if gaps > window:
            continue

        @lru_cache(None)
        def least(j):
            if not j:
                return 0
            ways = [least(i) + (0 if (n & (n - 1)) == 0 else window - n) for i in range(j) if (n := int(at[j] - at[i])) <= window]
            return min(ways) + int(cost[j])

        ends = packing.best_cuts(at, cost, window)
        size = np.diff(ends, prepend=0)
        spent = packing.padding(size, window).sum() + sum(int(cost[np.searchsorted(at, e)]) for e in ends)
        assert size.max() <= window and spent == least(len(at) - 1)


@pytest.mark.parametrize(("window", "block"), [(64, 500), (4096, 1 << 20)])
def test_packing_holds_every_id_once(spark, corpus, window, block):
    rows = [*corpus, *[(1000 + k, t) for k, t in enumerate(ODD)], (None, "null id."), (None, "null id."), (2000, "Hello<|endoftext|>World <|ENDOFTEXT|>. it's 'S. b?! c"), (2001, "İstanbul ΑΣ Σς K ʼn ß ﬁ. Á b́c. don'T, they'RE e. f. ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    p = packing.Params(WORD, window=window, block_ids=block, long_sentence=window // 2, grid=5, slice_bytes=3000, cache_bytes=10_000)
    got = packing.pack(docs, p).collect()
    docs_, seqs = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids
        docs_.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, len(ids), r.padding))
    for pieces in seqs.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window and {x[2] for x in pieces} == {0 if at & (at - 1) == 0 else window - at}
    text_of = dict(rows)
    for doc, pieces in docs_.items():
        if doc is None:
            continue
        whole = [i for _, ids, _ in sorted(pieces) for i in ids]
        assert whole == [*tokens(WORD, text_of[doc] or "", False), 2]
        assert [s for s, _, _ in sorted(pieces)] == np.cumsum([0, *[len(i) for _, i, _ in sorted(pieces)]])[:-1].tolist()
        assert {n for _, _, n in pieces} == {len(whole)}
    assert sum(len(ids) for _, ids, _ in docs_[None]) == 2 * (len(tokens(WORD, "null id.", False)) + 1)
    assert docs_.keys() == text_of.keys()


def test_packing_of_an_empty_table_and_little_padding(spark, corpus):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, packing.Params(WORD)).count() == 0
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(corpus * 20)], "doc_id long, text string").coalesce(1)
    seqs = packing.pack(docs, packing.Params(WORD)).groupBy("sequence_id").agg(F.sum(F.octet_length("ids") / 4).alias("n"), F.first("padding").alias("pad")).collect()
    assert sum(r.pad for r in seqs) < 0.01 * sum(r.n for r in seqs)


# --- conversation repair ---------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Rows of (conv, turn, role, text) -> report by a search over all edits."""
    convs, out = {}, {}
    for conv, turn, role, text in rows:
        group = convs.setdefault(conv, [])
        blank = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        group += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, group in convs.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in group:
            rest = text.rstrip(SPACE)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in group if t is not None}

        @lru_cache(None)
        def best(i, state, inserted):
            """(cost, audit, repaired lines) from row i on."""
            ways = [(0, "", ())] if i == len(group) and state in ("", "a") else []
            expect = "assistant" if state == "u" else "user"
            if inserted < 3:
                c, a, lines = best(i, expect[0], inserted + 1)
                ways.append((c + 5, "I" + a, (f"{expect}:", *lines)))
            if i < len(group):
                _, role, text = group[i]
                c, a, lines = best(i + 1, state, 0)
                ways.append((c + 2, "D" + a, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] else 0
                    c, a, lines = best(i + 1, expect[0], 0)
                    ways.append((c + 1 + more, "R" + a, (f"{expect}:{text}", *lines)))
                    if role[:1] == expect[0] or (role[:1] == "s" and state == ""):
                        c, a, lines = best(i + 1, role[0], 0)
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
            return min(ways, default=(10**9, "~", ()))

        cost, audit, lines = best(0, "", 0)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversation_rows():
    rng = random.Random(11)
    texts = ["Fine.", "Fine.", "Really?", "cut off", "  ", "", None, "Yes!\n", "Done. \t", "漢字。", "ends .", "a.b"]
    rows = []
    for conv in range(400):
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.1:
                continue
            role = "user" if turn % 2 == 0 else "assistant"
            if rng.random() < 0.25:
                role = rng.choice(["system", "tool", "", None, "user", "assistant", "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"Null {t}.") for t in range(6)]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Long {t % 40}.") for t in range(150)]
    rows += rows[:40]
    return rows


def test_repair_equals_a_search_over_all_edits(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("sign", F.lit(1)).withColumn("audit", F.lit("x"))
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.damage_report(df).collect()}
    want = plain_repair(rows)
    assert got == want
    assert {c for r in want.values() for c in r[6]} == set("KRD") and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()


def test_automaton_with_any_costs():
    """Inserts only pay at other costs than the default ones."""
    rng, used = random.Random(2), set()
    signs = sorted({"".join(rng.choice("suaoSUAx" + "ua" * 4) for _ in range(rng.randint(0, 9))) for _ in range(300)}, key=lambda s: s[::-1])
    for costs in (conversation_repair.Costs(), conversation_repair.Costs(3, 2, 1, 2), conversation_repair.Costs(2, 2, 1, 1), conversation_repair.Costs(1, 1, 1, 1)):
        auto = conversation_repair.Automaton(costs)
        for signature in signs:

            @lru_cache(None)
            def best(i, state, inserted):
                ways = [(0, "")] if i == len(signature) and state in ("", "a") else []
                expect = "a" if state == "u" else "u"
                if inserted < 3:
                    c, a = best(i, expect, inserted + 1)
                    ways.append((c + costs.insert, "I" + a))
                if i < len(signature):
                    sign = signature[i]
                    c, a = best(i + 1, state, 0)
                    ways.append((c + costs.delete, "D" + a))
                    if sign != "x":
                        more = costs.truncated if sign.isupper() else 0
                        c, a = best(i + 1, expect, 0)
                        ways.append((c + costs.rerole + more, "R" + a))
                        if sign.lower() == expect or (sign.lower() == "s" and state == ""):
                            c, a = best(i + 1, sign.lower(), 0)
                            ways.append((c + more, "K" + a))
                return min(ways, default=(10**9, "~"))

            cost, audit = best(0, "", 0)
            assert auto.solve(signature) == (audit, cost)
            used |= set(audit)
    assert used == set("KRDI")


def test_repair_of_hot_and_large_signatures(spark, monkeypatch):
    rows = [r for r in conversation_rows() if r[0] is not None][:300]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = plain_repair(rows)
    for share, size in ((0.02, 16 << 20), (1e-9, 0)):
        monkeypatch.setattr(conversation_repair, "HOT_SHARE", share)
        monkeypatch.setattr(conversation_repair, "HOT_BYTES", size)
        assert {r[0]: tuple(r)[1:] for r in conversation_repair.damage_report(df).collect()} == want


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    _, turns = conversation_repair.repair(conversation_repair.damaged(df))
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append(r)
    import re

    for rows in by.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows))


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.damage_report(df).count() == 0
