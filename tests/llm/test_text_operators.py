"""Operators 2, 3, 5 and 6 against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.llm import chat_format, packing, quality_rules, queries, token_counts

from .helpers import ODD, documents, no_documents, odd_documents, rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
TEXTS = [t or "" for _, t, _, _ in ODD]


# 2: token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.CountingViterbi.from_sentencepiece(MODEL)


def unigram_reference(pieces):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), *pieces.items(), *((f"<0x{b:02X}>", -1e12) for b in range(256))]
    t = Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def best_by_lattice(pieces, text):
    """Score and pieces by an explicit lattice over starts, in the tokenizers' order."""
    low, n = min(pieces.values()) - 10, len(text)
    score, count = [None] * (n + 1), [0] * (n + 1)
    score[0] = 0.0
    for a in range(n):
        single = False
        for b in range(a + 1, n + 1):
            if text[a:b] in pieces:
                single = single or b == a + 1
                if score[b] is None or score[a] + pieces[text[a:b]] > score[b]:
                    score[b], count[b] = score[a] + pieces[text[a:b]], count[a] + 1
        if not single and (score[a + 1] is None or score[a] + low > score[a + 1]):
            score[a + 1], count[a + 1] = score[a] + low, count[a] + len(text[a].encode())
    return score[n], count[n]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -2.5, -0.1]), min_size=1, max_size=12), st.text("abc é", max_size=14))
def test_viterbi_ties(pieces, text):
    c = token_counts.CountingViterbi(pieces)
    got = c.count(text)
    expected = best_by_lattice(pieces, c.normal(text)) if text else (0.0, 0)
    assert got[1] == expected[1]
    assert got[0] == pytest.approx(expected[0], abs=1e-9)


def test_counts_as_the_tokenizer(counter, spark):
    assert counter.splits
    reference = unigram_reference({p: s for p, s in counter.pieces.items()})
    texts = [t for t in TEXTS if len(t) < 10_000] + [r.text[:3000] for r in documents(spark).limit(40).collect()]
    for t in texts:
        if "<0x" not in t and t:
            assert counter.count(t)[1] == reference(counter.normal(t)), t[:80]


def test_whole_and_split_agree(counter, spark):
    for r in documents(spark).limit(15).collect():
        whole = counter.best(counter.normal(r.text))
        assert counter.count(r.text) == whole


def test_token_counts_query(spark, counter):
    got = rows(token_counts.count_tokens(odd_documents(spark), MODEL))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((d or 0, counter.count(t)[1]) for d, t, _, _ in ODD)
    assert token_counts.count_tokens(no_documents(spark), MODEL).count() == 0


# 3: packing


@given(st.integers(1, 100_000))
def test_lengths(n):
    parts = packing.lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts) and parts == sorted(parts, reverse=True)
    assert parts.count(1024) == n // 1024 and len(set(parts) - {1024}) == len([p for p in parts if p != 1024])


def test_fast_ids_are_the_tokenizers():
    fast, plain = packing.Ids(*BPE), packing.Ids(BPE[0])
    rng = random.Random(1)
    chars = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC)]
    texts = TEXTS + [a + c + b for c in chars for a, b in (("", ""), ("a", "b"), (" ", " "), ("1", "'s"))]
    texts += ["".join(rng.choices(chars, k=40)) for _ in range(3000)] + ["".join(rng.choices(" \n\t\r\x0b\x85\xa0\x1cab'1.", k=30)) for _ in range(3000)]
    for t in texts:
        assert fast.encode(t).tolist() == plain.encode(t).tolist(), repr(t[:60])
    assert packing.Ids.PLAIN.search("中") and not packing.Ids.PLAIN.search("é–")


def test_runs_have_the_ids_of_the_whole_text(monkeypatch):
    whole = packing.Ids(BPE[0])
    whole.in_runs = False
    rng = random.Random(2)
    parts = ["a", "Word", "don't", "'s", "42", " ", "  ", "\n", " \n", "\t", ".", ", ", "é", "中文", "\xa0", "\u2003", "<|endoftext|>", " the", " x1", "!? ", "_", "\x85", " (", "😀"]
    texts = ["".join(rng.choices(parts, k=400)) for _ in range(300)] + ["a" * 500, " " * 500, "ab " * 300, "a  b " * 200, ""]
    monkeypatch.setattr(packing.Ids, "RUN", 40)
    fast, plain = packing.Ids(*BPE), packing.Ids(BPE[0])
    assert plain.in_runs and len(list(plain.runs("ab " * 300))) > 10
    for t in texts:
        assert "".join(plain.runs(t)) == t
        assert fast.encode(t).tolist() == plain.encode(t).tolist() == whole.tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE[0])
    docs = odd_documents(spark)
    got = rows(packing.pack(docs, *BPE, with_ids=True))
    assert len({r["sequence_id"] for r in got}) == len(got)
    texts = {d: t for d, t, _, _ in ODD}
    for doc, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = [r for r in got if r["doc_id"] == doc]
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        copies = sum(d == doc for d, _, _, _ in ODD)
        for r in own:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids"] == piece and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["offset"] == 0
            assert r["length"] == 1 << r["bucket"] <= 1024
        assert sum(r["length"] for r in own) == copies * len(ids)
        assert sorted(r["start"] for r in own)[::copies] == np.cumsum([0, *packing.lengths(len(ids))])[:-1].tolist()
    assert packing.pack(no_documents(spark), *BPE).count() == 0


# 5: chat format


@given(st.text(), st.text())
def test_escape(role, text):
    segment = chat_format.format_turn(role, [{"type": "text", "text": text}])["segment"]
    assert chat_format.read_turns(segment) == [(role, text)]
    assert segment.count("\\") >= text.count("\\")


def test_parts():
    parts = [
        {"type": "text", "text": "see <image 0>"}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"type": "audio", "ref": "a.wav", "seconds": 1.5},
        {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": "text", "text": None},
    ]
    got = chat_format.format_turn("user", parts)
    assert got["segment"] == "<turn user>see \\<image 0\\><image 0><audio 1><document 2></turn>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 1024)]
    assert got["attached_tokens"] == 1065 and got["loss_length"] == 0
    with pytest.raises(ValueError, match="unknown"):
        chat_format.format_turn("user", [{"type": "video"}])


def digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_read_back(spark):
    nasty = ["", "a</turn>\n<turn assistant>b", "\\", "\\\\<", "é\U0001f600\r\n", None, "x" * 200_000]
    turns = [(c, t, ["user", "assistant", "system", None, "a>b\n"][(c + t) % 5], nasty[(c * 3 + t) % 7], "extra") for c in range(12) for t in range(c)]
    turns += [(None, 0, "user", "no id", "e"), (5, None, "user", "last", "e"), (3, 1, "user", "tied", "e"), (3, 1, "user", "tied", "e")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, segment string").repartition(5)
    got = rows(chat_format.read_back(chat_format.format_turns(df.withColumn("content", chat_format.text_part("text")))))
    by = {}
    for c, t, role, text, _ in turns:
        by.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: digest([x[2:] for x in sorted(v)]) for c, v in by.items()}
    empty = chat_format.format_turns(df.where("false").withColumn("content", chat_format.text_part("text")))
    assert chat_format.read_back(empty).count() == 0


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in rows(queries.op5_chat_format(spark, "/root/testdata/sf0.001"))}
    said = r"\### Assistant: </turn> ok"
    assert (got[-7]["n_turns"], got[-7]["turns_sha256"], got[-7]["loss_chars"], got[-7]["loss_sha256"]) == digest([("user", said), ("assistant", said)])


def test_typed_content(spark):
    part = spark.createDataFrame([(1, 0, "user", [("image", None, "r", 28, 28, None, None)])], f"conv_id bigint, turn bigint, role string, content array<{chat_format.PART}>")
    got = chat_format.format_turns(part).first()
    assert got.attached_tokens == 1 and got.attachments[0].ref == "r" and "<image 0>" in got.segment


# 6: quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    inside = set()
    for i, w in enumerate(windows):
        if w in repeated:
            inside.update(range(i, i + 8))
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": n < 20 or 100 * len(inside) > 30 * n}


def test_base_counts(spark):
    judge = quality_rules.LineJudge(quality_rules.LineRules())
    texts = TEXTS + [r.text for r in documents(spark).collect() if len(r.text) < 20_000]
    rng = random.Random(2)
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(300)] + ["a\nb\na\n\n \na", "x " * 100, " ".join(map(str, range(8))) * 2]
    for t in texts:
        got = quality_rules.judge_text(t, judge)
        assert {k: got[k] for k in plain_counts(t)} == plain_counts(t), t[:80]


def test_lines():
    judge = quality_rules.LineJudge(quality_rules.LineRules())
    good = "The committee met on Tuesday and settled the matter after a long debate."
    bad = ["Home | News | Sport | Weather | Contact", "Menu", "All rights reserved.", "### $$$ %%% ***", "BUY NOW!! CHEAP!! FAST!!", "read more"]
    assert judge.failed(good) is None and all(judge.failed(b) for b in bad)
    long = "\n".join([good, good.replace("Tuesday", "Friday")] * 2 + bad[:2])
    got = quality_rules.judge_text(long, judge)
    assert got["clean_text"].count("\n") == 3 and "Menu" not in got["clean_text"] and not got["lost_chars"] == 0
    mostly_bad = good + "\n" + "\n".join(f"{w} | a{w} | b{w} | c{w}" for w in map(str, range(40)))
    assert not quality_rules.judge_text(mostly_bad, judge)["kept"]
    unpunctuated = " ".join(f"word{i}" for i in range(60))
    assert quality_rules.judge_text(unpunctuated, judge)["kept"]


def test_quality_rules_query(spark):
    got = rows(quality_rules.clean_lines(odd_documents(spark)))
    assert len(got) == len(ODD) and quality_rules.clean_lines(no_documents(spark)).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[3]["base_failed"] and not by[3]["kept"] and by[3]["clean_text"] is None and by[4]["clean_text"] == "" and by[5]["n_words"] == 0


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    got = queries.op6_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed")
    assert got.where("kept").count() >= 0.97 * got.count()
    assert got.agg(F.count("*")).first()[0] > 100


def test_verdict_by_plain_rules(spark):
    """``kept`` and the cleaned text, from rules written out line by line."""
    rules = quality_rules.LineRules()

    def fails(line):
        n = len(line)
        if sum(line.count(c) for c in "#*$%&|<>") > 0.1 * n:
            return True
        parts = re.split(r"\s[|»›>]\s", line)
        if len(parts) > 3 or re.fullmatch(r"\s*(home|menu|login|search|next|previous|share)[\s|>»]*", line, re.I):
            return True
        low, held = line.lower(), 0
        while low:
            found = [(low.index(p), k, p) for k, p in enumerate(rules.boilerplate) if p in low]
            if not found:
                break
            at, _, p = min(found)
            held, low = held + len(p), low[at + len(p) :]
        if held and held >= 0.05 * n:
            return True
        letters = [c for c in line if c.isalpha()]
        if line.count("!!") >= 3 or (n >= 20 and sum(c.isupper() for c in line) > 0.8 * len(letters)):
            return True
        return not re.search(r"[.!?…。！？][\"'”’»)\]]*(\s|$)", line) and len(line.split()) < 4

    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    extra = [(1000 + i, t) for i, t in enumerate(["Home | Menu | Search | Login", "Alle Rechte vorbehalten.", "x " * 300 + "cookie end.", "A cookie.", "SHOUTING IS NOT ALLOWED HERE AT ALL", "ok\nfine", "yes!! yes!! yes!!"])]
    docs = [(r.doc_id, r.text) for r in documents(spark, "0.01").collect()] + extra
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in quality_rules.clean_lines(df).collect()}
    rejected = 0
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        bad = [bool(words(x)) and fails(x) for x in lines]
        chars = [sum(map(len, words(x))) for x in lines]
        kept = not got[doc_id].base_failed and sum(c for c, b in zip(chars, bad, strict=True) if b) <= 0.5 * sum(chars)
        assert got[doc_id].kept == kept, text[:200]
        assert got[doc_id].clean_text == "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)
        rejected += not kept
    assert 0 < rejected < len(docs)


def test_fast_look_for_phrases():
    """It says no only where the pattern finds nothing."""
    judge, rng = quality_rules.LineJudge(quality_rules.LineRules()), random.Random(4)
    bits = ["cookie", "COO", "\u212aie", "avi\u017fo legal", "Aviso Legal", "MENTIONS LÉGALES", "cond\u0131ciones de uso", "\u0130mpressum", "Impressum", "plain words", " ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 5)))
        assert judge.may_hold_phrases(text) or not judge.boilerplate.search(text), repr(text)
    greek = quality_rules.LineJudge(quality_rules.LineRules(boilerplate=("\u03b2ita",)))
    assert greek.may_hold_phrases("\u03d0ita") and greek.boilerplate.search("\u03d0ita")


def test_boilerplate_at_every_length():
    """The same mixture of words and phrases is judged alike, short or long."""
    judge = quality_rules.LineJudge(quality_rules.LineRules())
    line = "Read our privacy policy and the terms of use before you go on. "
    assert all(judge.failed((line * n).strip()) == "boilerplate" for n in (1, 5, 50))
    plain = "These are ordinary words of an ordinary sentence that nobody minds at all, even if it is a long one. "
    assert all(judge.failed(("A cookie is a cake. " + plain * 3) * n) is None for n in (1, 5, 50))
