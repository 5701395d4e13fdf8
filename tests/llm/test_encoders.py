import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, pieces, token_counts, token_files

MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTES)
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t▁'aeinst.,")), max_size=40)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_match_the_library(text):
    coder = bpe.piece_coder(MODEL)
    assert coder.encode(text) == coder.library.encode(text)


def test_pieces_on_words_and_runs():
    coder, rng = bpe.piece_coder(MODEL), random.Random(5)
    vocabulary = list(coder.ids)
    for k in range(4000):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randrange(8))) if k % 2 else "".join(rng.choice("ab  ▁.,\n") for _ in range(rng.randrange(40)))
        assert coder.encode(text) == coder.library.encode(text), text
    for text in (" " * 5000, "a" * 5000, "ab" * 3000 + "é" * 100, "▁" * 77, "\n" * 50):
        assert coder.encode(text) == coder.library.encode(text)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_match_the_library(text):
    counter = token_counts.prefix_counter(BYTES)
    sums = counter.counts(text)[1]
    assert (sums[-1] if sums else 0) == len(library(text))
    assert token_files.encoder(BYTES)(text).tolist() == library(text)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab '\n\t\r\x1f\x85\xa0 sltrevm1.é漢\u200b\u3000|<>"), max_size=16).map(lambda t: t.replace("|", "<|endoftext|>")), st.integers(0, 6))
def test_every_prefix(text, budget):
    counter = token_counts.prefix_counter(BYTES)
    brute = [len(library(text[:n])) for n in range(len(text) + 1)]
    assert counter.every_prefix(text) == brute
    stored = token_counts.Prefixes(token_counts.Prefixes.stored(counter.steps(text)))
    assert [stored.count(n) for n in range(len(text) + 1)] == brute and stored.count() == brute[-1]
    assert stored.longest_within(budget) == max(n for n, c in enumerate(brute) if c <= budget)


def test_every_prefix_of_real_texts(spark):
    counter = token_counts.prefix_counter(BYTES)
    texts = [r["text"][:400] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    for text in [*texts, "x!?<|endoftext|>'re <|endo 'll", "a  b\n\n  c \n", "  ", "we've 're\t\n", "=" * 150 + " " * 150]:
        assert counter.every_prefix(text) == [len(library(text[:n])) for n in range(len(text) + 1)], text


def test_characters_in_prefixes():
    """Blanks, letters and signs of every kind at the ends of prefixes."""
    counter = token_counts.prefix_counter(BYTES)
    chars = [chr(c) for c in [*range(0x2100), *range(0x2FF0, 0x3100), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F700, 7)]]
    for c in chars:
        text = f"a {c}{c}b {c}"
        assert counter.every_prefix(text) == [len(library(text[:n])) for n in range(len(text) + 1)], repr(c)


def test_long_words_take_linear_time():
    import time

    counter, begun = token_counts.prefix_counter(BYTES), time.process_time()
    word = "".join(random.Random(6).choice("abcdefgh") for _ in range(100_000))
    counts = counter.every_prefix(word)
    assert time.process_time() - begun < 10
    assert all(counts[n] == len(library(word[:n])) for n in (1, 17, 500, 4000, 4097, 50_000, 100_000))


def test_common_characters_split_alike():
    """All characters that the fast path takes, in the places where splitting looks at them."""
    counter = token_counts.prefix_counter(BYTES)
    for c in filter(counter.common, map(chr, range(0x3000))):
        for text in (f"a{c}b", f" {c}", f"{c} {c}{c} x", f"1{c}'s"):
            assert counter.words(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], repr(c)


def test_backtracking_and_table():
    table, ids, _ = bpe.byte_level(BYTES)
    for text in ("hello", "thththth", "\x80\xff" * 9, "a" * 300):
        raw = text.encode().decode("latin-1")
        by_steps = [ids[r] for r in table.encode(raw)]
        last, count = table.prefixes(raw)
        back, at = [], len(raw) - 1
        while at >= 0:
            back.append(ids[last[at]])
            at -= table.size[last[at]]
        assert by_steps == back[::-1] and count[-1] == len(by_steps)


def test_piece_query(edge):
    rows = pieces.encode_decode(edge, MODEL).collect()
    sp = bpe.piece_coder(MODEL).library
    assert len(rows) == 9
    for r in rows:
        text = {x["doc_id"]: x["text"] for x in edge.collect()}[r["doc_id"]] or ""
        ids = sp.encode(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(edge.where("false"), MODEL).count() == 0


def test_count_query(edge):
    text = {x["doc_id"]: x["text"] or "" for x in edge.collect()}
    table = token_counts.prefix_table(edge, BYTES)
    rows = token_counts.token_counts(table, limit=3).collect()
    assert len(rows) == 9
    for r in rows:
        t = text[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(library(t)))
        assert r["over_limit"] == (r["n_tokens"] > 3)
        if len(t) < 100:
            assert r["chars_within"] == max(n for n in range(len(t) + 1) if len(library(t[:n])) <= 3)
    for r in table.where("doc_id in (1, 3, 6)").collect():
        stored = token_counts.Prefixes(bytes(r["counts"]))
        assert [stored.count(n) for n in range(len(text[r["doc_id"]]) + 1)] == [len(library(text[r["doc_id"]][:n])) for n in range(len(text[r["doc_id"]]) + 1)]
    assert token_counts.token_counts(token_counts.prefix_table(edge.where("false"), BYTES)).count() == 0


def test_ids_of_whole_documents(spark):
    """The fast encoder and the counts against the library on all documents of a table."""
    encode, counter = token_files.encoder(BYTES), token_counts.prefix_counter(BYTES)
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect():
        ids = library(r["text"] or "")
        assert encode(r["text"] or "").tolist() == ids and (counter.counts(r["text"] or "")[1] or [0])[-1] == len(ids)


def test_words_are_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(token_files.WordIds, "KEPT", 3)
    words, asked = token_files.WordIds(token_files.library(BYTES).encode), []
    encode = words.encode
    words.encode = lambda w, **more: asked.append(w) or encode(w, **more)
    for w in ["a", " b", "c", "d", "a", "e", "x" * 100, "a", "x" * 100]:
        assert np.frombuffer(words[w], np.uint32).tolist() == library(w)
    assert len(words) <= 3 and asked.count("a") == 1 and asked.count("x" * 100) == 2


def test_words_are_split_and_encoded_cheaply(monkeypatch):
    """New words go to the library's model, not through a whole call; letters and digits are the library's beyond ASCII too."""
    words = token_files.ModelIds(LIBRARY.model.tokenize)
    rng, letters = random.Random(7), " \n\xa0\x85'srtveldm19²¼ªßéĀɏ‐‧€"
    common = [c for c in map(chr, range(0x2100)) if re.fullmatch(token_counts.COMMON, c)]
    for _ in range(5000):
        text = "".join(rng.choice(common if rng.random() < 0.5 else letters) for _ in range(rng.randrange(30)))
        split = token_files.common_words()(text)
        assert split == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert np.frombuffer(b"".join(words[w] for w in split), np.uint32).tolist() == library(text)

    class Spied:
        whole = []
        model, get_added_tokens_decoder = LIBRARY.model, LIBRARY.get_added_tokens_decoder

        def encode(self, text, **more):
            self.whole.append(text)
            return LIBRARY.encode(text, **more)

    monkeypatch.setattr(token_files, "library", lambda path: Spied())
    encode = token_files.encoder.__wrapped__(BYTES)
    for text in ("Größe, naïve café 12²", "plain words", "漢字", "a<|endoftext|>b"):
        assert encode(text).tolist() == library(text)
    assert Spied.whole == ["漢字", "a<|endoftext|>b"]


def test_dictionary_sample_is_bounded(documents, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 3)
    rows = [(1, "one two three")] * 50 + [(k % 3, f"text {k}") for k in range(40)]
    docs = documents(rows).select("doc_id", "text")
    assert token_files.train_dictionary(docs, BYTES, 2) == token_files.train_dictionary(docs.repartition(5), BYTES, 2) != b""


def brute_files(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.blake2b((r[1] or "").encode(), digest_size=8).digest()))
    out, start = [], 0
    for i, t in order:
        ids = library(t or "") + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, edge, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (edge, docs):
        path = token_files.write_token_files(df, BYTES)
        got = token_files.read_token_files(spark, path).collect()
        want = brute_files([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    some = token_files.fetch(spark, path, [3, 17, 10**9])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert some == {i: [library(text[i]) + [0]] for i in (3, 17)}
    assert token_files._dictionary(spark, path)  # large enough to train on
    few = token_files.write_token_files(edge, BYTES)
    assert token_files._dictionary(spark, few) and len(token_files.fetch(spark, few, [3])[3]) == 2  # a row each
    empty = token_files.write_token_files(edge.where("false"), BYTES)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_block_keeps_its_dictionary():
    data = token_files.pack_block([(5, 2, b"x"), (None, 1, b"y")], 7, 2, hashlib.sha256(b"").digest())
    block = token_files.Block(data, b"")
    assert block.before == 7 and block.doc_ids.tolist() == [5, 0] and block.null.tolist() == [0, 1]
    with pytest.raises(ValueError):
        token_files.Block(data, b"other")
    with pytest.raises(ValueError):
        token_files.Block(b"none" + data[4:], b"")
