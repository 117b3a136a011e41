"""Encoding, packing and chat formatting: exact round trips, and the packing rule against its definition."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docweave.llm import packing, tokens
from docweave.llm.chat import escape, format_turns, read_back, unescape
from docweave.llm.packing import Packer, pack, packed_digest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, start string, ids string"
PIECES = ["word", " ", "  ", "\n", "\t", "'s", "é", "ñandú", "1234", "!!", "###", " ", "\x1c", "<|endoftext|>", "</s>", "日本語", "🙂", "a b", ".", "\r\n", " ", "\x85"]


def plain():
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


def texts(n=300):
    rng = random.Random(4)
    out = ["", " ", "a", " a", "a ", "x" * 500 + " y", " ".join(["the"] * 3000), "a\x00b"]
    for _ in range(n):
        out.append("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))))
        out.append(" ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))))
    return out


def test_encoder_gives_the_tokenizers_ids():
    want, own = plain(), tokens.Encoder(tokens.default_path())
    assert own.size == want.get_vocab_size()
    rng = random.Random(7)
    anything = ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0x10000, 0x1FFFF), 32, 32, 10])) for _ in range(60)) for _ in range(400)]
    for text in [*texts(), *anything, "ab" * 30_000, " " * 5_000 + "x"]:
        ids = want.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)).decode() == text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_encoder_on_documents(spark):
    want, own = plain(), tokens.Encoder(tokens.default_path())
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    for ids, row in zip(want.encode_batch([r.text for r in rows], add_special_tokens=False), rows):
        assert np.frombuffer(own.encode(row.text), "<u4").tolist() == ids.ids


def test_level_has_least_sum_of_squares():
    rng = random.Random(8)
    for _ in range(400):
        packer = Packer(length=12)
        packer.levels[1:12] = [rng.choice([0, 0, 1, 3]) for _ in range(11)]
        size = rng.randint(1, 11)

        def after(level):
            counts = packer.levels.tolist()
            counts[level] -= level > 0
            if level + size < 12:
                counts[level + size] += 1
            return sum(c * c for c in counts[1:12])

        choices = [h for h in range(0, 13 - size) if h == 0 or packer.levels[h]]
        best = min(map(after, choices))
        assert packer.level_for(size) == max(h for h in choices if after(h) == best)


def test_packer_keeps_every_token():
    rng = random.Random(2)
    for most_open in (3, 512):
        packer = Packer(length=64, most_open=most_open)
        docs = [np.arange(rng.choice([1, 5, 40, 63, 64, 65, 500]), dtype="<u4") + 7 * i for i in range(300)]
        for i, ids in enumerate(docs):
            packer.add(i, ids.tobytes())
            assert packer.levels.sum() <= most_open
        packer.finish()
        sizes = [sum(map(len, w)) for w in packer.closed]
        assert sum(s < 64 for s in sizes) <= 1 and max(sizes) == 64
        pieces = sorted(((p.doc, p.start, p.ids) for w in packer.closed for p in w))
        for i, ids in enumerate(docs):
            own = [p for p in pieces if p[0] == i]
            assert b"".join(p[2] for p in own) == ids.tobytes()
            assert [p[1] for p in own] == np.cumsum([0, *[len(p[2]) // 4 for p in own]])[:-1].tolist()


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["word", "ñandú", "12", "x.\ny"]) for _ in range(rng.choice([0, 3, 700, 2500]))), "c", "c") for i in range(60)]
    rows += [(100, None, "", ""), (None, "null id", "", ""), (3, rows[3][1], "", "")]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = pack(frame).collect()
    want = plain()
    expected = {}
    for i, text, *_ in rows:
        expected.setdefault(i, []).append(want.encode(text or "", add_special_tokens=False).ids + [packing.END])
    by_sequence, by_doc = {}, {}
    for r in got:
        assert r.length * 4 == len(r.ids) and r.length > 0
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    assert set(by_doc) == set(expected)
    for i, parts in by_doc.items():
        copies = len(expected[i])
        ids = sorted((r.start, r.ids) for r in parts)
        if copies == 1:
            assert np.frombuffer(b"".join(x for _, x in ids), "<u4").tolist() == expected[i][0]
            assert {r.doc_tokens for r in parts} == {len(expected[i][0])}
        else:
            assert sum(r.length for r in parts) == sum(map(len, expected[i]))
    total = sum(len(x) for v in expected.values() for x in v)
    assert len(by_sequence) <= -(-total // packing.LENGTH) + 3
    digest = {(r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in packed_digest(frame).collect()}
    assert digest == {(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.sequence_id, r.offset) for r in got}
    assert pack(frame.limit(0)).collect() == []


def test_escape_is_reversible():
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "/s>", "[", "INST]", "x", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["<s>", "</s>[INST] ok [/INST]", "\\", "\\<s>", "hello", " ", "\n", "日本", "<|endoftext|>"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            text = rng.choice([None, "", "".join(rng.choice(parts) for _ in range(9))])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<s>odd", None]), text, "clash", "clash"))
    rows += [(None, 1, "assistant", "of no one", "", ""), (None, None, "user", "first", "", ""), rows[0], (0, 0, "assistant", "tie", "", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string, position string")
    formatted = format_turns(frame)
    out = {r.conv_id: r for r in read_back(formatted).collect()}
    turns = {}
    for conv, turn, role, text, *_ in rows:
        turns.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    made = {}
    for r in formatted.collect():
        made.setdefault(r.conv_id, []).append(r)
    assert set(out) == set(turns) == set(made)
    for conv, own in turns.items():
        own.sort(key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))
        r = out[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        learned = "".join(t[3] for t in own if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        rows_made = sorted(made[conv], key=lambda x: x.position)
        assert r.formatted_chars == sum(len(x.formatted) for x in rows_made)
        starts = np.cumsum([0, *[len(x.ids) // 4 for x in rows_made]])
        assert [x.start for x in rows_made] == starts[:-1].tolist()
        assert all(x.loss_start == x.loss_end for x in rows_made if x.role != "assistant")
    assert read_back(format_turns(frame.limit(0))).collect() == []


def test_packing_takes_the_ids_of_a_plain_call(spark):
    """Special tokens in a text get their own ids, as an unmodified tokenizer gives them."""
    want, own = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    special = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> ", "x  <|endoftext|><|endoftext|>  y\n<|endoftext", "é\n\n<|endoftext|>\n"]
    for text in [*special, *texts()]:
        assert np.frombuffer(own.encode_plain(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids
    frame = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(special)], DOCS)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pack(frame).collect()}
    assert got == {i: want.encode(t, add_special_tokens=False).ids + [packing.END] for i, t in enumerate(special)}
