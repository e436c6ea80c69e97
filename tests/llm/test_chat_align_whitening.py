"""Chat formatting, alignment of tokenizers and whitening against plain computations, and on rows at the edges."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import align, chat, queries, whitening

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11 ------------------------------------------------------------------------------------------------------------------

PROBE = "</s>[INST] ok [/INST]"


def plain_chat(turns):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) from the rows themselves."""
    by = defaultdict(list)
    for c, t, role, text in [*turns, (-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(x for *_, role, x in own if role == "assistant")
        out[c] = (len(own), sha("".join(f"{role}\n{x}\n" for *_, role, x in own)), len(loss), sha(loss))
    return out


HARD = [
    (1, 0, "user", "<s> <\\s> <\\\\</s> [INST] [\\/INST] <|part|>"),
    (1, 1, "user", "<|en"),
    (1, 2, "user", "d|>"),
    (1, 3, "assistant", "<"),
    (1, 4, "assistant", None),
    (1, 5, "assistant", "\\<|end|>\\"),
    (1, 6, "tool<|message|>", "😀<|start|>é"),
    (1, 7, "assistant", "last"),
    (2, None, None, None),
    (2, 3, "assistant", "after null"),
    (2, 3, "assistant", "after null"),
    (None, 0, "assistant", "no id"),
    (3, 0, "system", "alone"),
    (4, 0, "assistant", "x" * 300_000 + "<s>"),
    *((5, i, ("user", "assistant")[i // 3 % 2], f"turn {i} [INST]") for i in range(1000)),
]


def test_chat_reads_back_what_went_in(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    for turns in (real, HARD, []):
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op11_chat(spark.createDataFrame(turns, TURNS)).collect()}
        assert got == plain_chat(turns)


def test_chat_query_runs_on_its_table(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.queries()["op11_chat"](spark, SMALL).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == plain_chat(real)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_chat_merges_marks_and_windows(spark):
    out = chat.formatted(spark.createDataFrame(HARD, TURNS).withColumn("pieces", F.lit(1)).withColumn("window", F.lit(2))).collect()
    by = {(r["conv_id"], r["window"]): r for r in out}
    first = by[1, 0]
    assert first["text"].count("<|start|>") == 4 and first["text"].count("<|part|>") == 4 and first["text"].startswith("<s><|start|>user<|message|>")
    for mark in chat.CONTROL:
        assert mark in (chat.BEGIN, chat.START, chat.MESSAGE, chat.PART, chat.END) or not any(mark in r["text"] for r in out)
    assert [first["text"][s["start"] : s["end"]] for s in first["loss_spans"]] == ["<", "", "\\<\\|end|>\\", "last"]
    assert {w for c, w in by if c == 5} == {0, 1, 2, 3}


def test_chat_has_no_python_in_its_formatting(spark):
    plan = chat.read_back(chat.formatted(spark.createDataFrame(HARD, TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "s>", "/s>", "\\", "[", "INST]", "|end|>", "a", "|part|>", "\n"]), max_size=12).map("".join), min_size=1, max_size=8))
def test_chat_escape_is_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


# 12 ------------------------------------------------------------------------------------------------------------------


def plain_align(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(c): c for c in chars} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)}
    found, counts = [], Counter()
    for doc_id, text in docs:
        groups, links, n = [], [], (0, 0)
        if text:
            ea = a.encode(" " + text, add_special_tokens=False)
            ta = [(i, bytes(table[c] for c in s)) for i, s in zip(ea.ids, ea.tokens, strict=True)]
            tb = []
            for i in b.encode(text):
                p = b.id_to_piece(i)
                tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb):
                ends = []
                for t in (ta, tb):
                    at, own = 0, []
                    for i, x in t:
                        at += len(x)
                        own.append((at, i))
                    ends.append(own)
                cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
                left = [iter(own) for own in ends]
                for c in cuts:
                    groups.append([])
                    for tokens in left:
                        groups[-1].append([])
                        for e, i in tokens:
                            groups[-1][-1].append(i)
                            if e == c:
                                break
                links = [(ga[-1], gb[-1]) for ga, gb in groups]
                n = (len(ta), len(tb))
        counts.update(links)
        found.append((doc_id, *n, groups, links))
    best = defaultdict(int)
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    say = lambda ids: ",".join(map(str, ids))
    return [(d, na, nb, len(g), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), sha(";".join(f"{say(x)}|{say(y)}" for x, y in g)) if g else "") for d, na, nb, g, ls in found]


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n and\ttabs \r\n"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "▁ a piece mark"), (None, "no id"), (7, "same"), (7, "same"),
    (8, "日本語 ñandú 😀👩‍👩‍👧 ​ ͸ \U0001fae8 İ"), (9, "\x00\x01\x7f\x85\xa0 x"), (10, "a" * 20_000), (11, " " * 5_000 + "x"), (12, "I'll don't 'S 12345 6.7e8 ²³"), (13, "é ǅ ʰ ₂ Ⅷ ٣"),
]


def test_align_equals_a_plain_reading(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for docs, size in ((real, align.BLOCK), (ODD, align.BLOCK), (ODD, 50), ([], 50)):
        df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, pair string")
        assert rows(align.link_counts(*align.linked_blocks(df, block=size)).select(*cols)) == sorted(plain_align(docs), key=repr)


def test_align_gives_groups_of_ids(spark):
    got = {r["doc_id"]: r["groups"] for r in align.aligned(spark.createDataFrame([(1, "hello alignment of tokens"), (2, None)], "doc_id bigint, text string")).collect()}
    a, b = align.tokenizer(align.BYTE_LEVEL), align.tokenizer(align.PIECES)
    assert got[2] == []
    assert sum((g["a"] for g in got[1]), []) == a.ids("hello alignment of tokens").tolist() and sum((g["b"] for g in got[1]), []) == b.ids("hello alignment of tokens").tolist()
    for g in got[1]:
        assert b"".join(a.entries[i] for i in g["a"]) == b"".join(b.entries[i] for i in g["b"])


def test_ranks_split_as_the_file_does():
    """Every character that takes the fast way, beside letters, numbers, marks and spaces."""
    t = align.ByteLevel(align.BYTE_LEVEL)
    common = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and align.common(chr(c))]
    assert t.fast is not None and len(common) > 21_000
    for i in range(0, len(common), 200):
        text = "".join(f"a{c}{c}1{c}, {c}  {c}\n" for c in common[i : i + 200])
        assert t.ids(text).tolist() == t.slow.encode(" " + text, add_special_tokens=False).ids


def test_long_runs_take_the_slow_way():
    assert align.common("") and align.common("a" * 4999 + " " * 499) and not align.common(" " * 500 + "a") and not align.common("b" * 5000)
    assert not align.common("\U0001f600") and not align.common("\x00") and not align.common("ok \u200b")


def test_align_query_has_every_document(spark):
    got = queries.queries()["op12_align"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got.count() == docs.count() and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


# 13 ------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>"


def check_whitening(spark, vectors, most=8, df=None):
    got = whitening.op13_whitening(spark.createDataFrame(vectors, VECTORS) if df is None else df).collect()
    kept = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(np.float64)) + 100_000) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    s, n = x.sum(axis=0), len(x)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-12 * e.sum()).sum()) if e.sum() > 1e-9 else 0)
    assert len(got) == k * n and {r["n"] for r in got} <= {n}
    y = c @ u[:, :k] / np.sqrt(e[:k])
    want, have = defaultdict(list), defaultdict(list)
    exact = [sum(int(n * a - b) ** 2 for a, b in zip(map(int, v), map(int, s), strict=True)) for _, v in kept]
    for j in range(k):
        col = np.array([r["whitened"] for r in got if r["component"] == j + 1])
        sign = 1 if abs(np.sort(col) - np.sort(y[:, j])).max() <= abs(np.sort(col) - np.sort(-y[:, j])).max() else -1
        for (i, _), d, v in zip(kept, exact, y[:, j], strict=True):
            want[i, j + 1, d].append(round(sign * v, 6) + 0.0)
        for r in got:
            if r["component"] == j + 1:
                have[r["vec_id"], j + 1, r["deviation"]].append(round(r["whitened"], 6) + 0.0)
                assert r["explained"] == pytest.approx(e[j] / e.sum(), rel=1e-6) and r["identity_error"] < 1e-8
    assert want.keys() == have.keys()
    for key in want:
        assert np.allclose(sorted(want[key]), sorted(have[key]), atol=3e-6)
    return got


def test_whitening_equals_the_full_decomposition(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check_whitening(spark, [tuple(r) for r in df.select("vec_id", "embedding").collect()], df=df.withColumn("x", F.lit(1)).withColumn("n", F.lit("a")))


def test_whitening_query_runs_on_its_table(spark):
    got = queries.queries()["op13_whitening"](spark, SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 8 * 500


def test_whitening_at_the_edges(spark):
    r = np.random.default_rng(5)
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0]), (104, [])]
    few = [(i, [float(v) for v in r.normal(size=3)]) for i in range(20)]
    check_whitening(spark, [*few, *few[:3], (None, [0.5, 0.25, 9.0]), *bad])  # fewer dimensions than components
    flat = [(i, [float(a), float(2 * a), 1.0, 1.0]) for i, a in enumerate(r.normal(size=30))]
    assert check_whitening(spark, [(i, [v[0], 1.0, v[2]]) for i, v in flat])  # one direction only
    for none in ([], bad, few[:1], [few[0]] * 4):
        assert whitening.op13_whitening(spark.createDataFrame(none, VECTORS)).collect() == []
    huge = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])]
    assert None in {x["deviation"] for x in whitening.op13_whitening(spark.createDataFrame(huge, VECTORS)).collect()}


def test_whitening_goes_on_until_certified(spark):
    """A steep spectrum keeps a narrow block, a flat one is widened; both end with small residuals."""
    r = np.random.default_rng(6)
    turn = np.linalg.qr(r.normal(size=(60, 60)))[0]
    for scale, within in ((3.0 ** -np.arange(60), 12), (1.0 - 0.001 * np.arange(60), 12)):
        x = (r.normal(size=(400, 60)) * scale) @ turn
        grid = whitening.on_grid(spark.createDataFrame([(i, [float(c) * 50 for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"))
        fitted = whitening.fit(grid, k=3)
        assert fitted.passes <= within and (fitted.residuals <= 1e-12 * fitted.variances[0]).all()
        assert whitening.identity_error(grid, fitted) < 1e-8
