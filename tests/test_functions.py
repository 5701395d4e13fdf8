import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import audio, chunks, ssml, text, titles


@pytest.fixture
def on(spark):
    """Applies a column function to texts."""

    def run(fn, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()
        out = [r["r"] for r in rows]
        return out[0] if len(values) == 1 else out

    return run


KEEP = {
    "Chapter 1": "chapter-num", "CHAPTER XII: The Road": "chapter-num", "Chapter x": "chapter-num", "Chapter b": "chapter-word", "Chapter the First": "chapter-any",
    "Part 2": "part", "Book III": "book-num", "Volume 4": "volume", "Prologue": "prologue", "Epilogue: After": "epilogue", "Preface": "preface",
    "Introduction": "introduction", "Foreword by X": "foreword", "Afterword": "afterword", "Appendix A": "appendix", "  Chapter 7  ": "chapter-num", "Chapter Ié": "chapter-num",
}
SKIP = {
    "Cover": "cover", "cover image": "cover", "Copyright": "copyright", "Chapter 3: Copyright": "copyright", "Title Page": "title-page", "Titlepage": "title-page",
    "Contents": "contents", "Table of Contents": "contents", "TOC": "toc", "Acknowledgements": "acknowledgements", "Acknowledgments": "acknowledgements",
    "About the Author": "about-author", "About the Book": "about-book", "About book": "about-book", "Dedication": "dedication", "Also by X": "also-by",
    "Colophon": "colophon", "Preview of": "preview", "Excerpt": "excerpt", "Discussion Questions": "discussion", "Praise for X": "praise",
    "Information": "information", "Notes": "notes", "References": "references", "Index": "index", "Glossary": "glossary", "Map": "map",
    "List of Illustrations": "illustrations", "List of Figures": "figures", "": "empty-title", "   ": "empty-title",
}


def test_titles(on):
    cases = {k: ("KEEP", v) for k, v in KEEP.items()} | {k: ("SKIP", v) for k, v in SKIP.items()} | {k: ("AMBIGUOUS", "") for k in ("The Beginning", "Chapters", "Maps of", "Bookkeeping")}
    got = on(titles.classify, *cases)
    assert {k: (r["decision"], r["rule"]) for k, r in zip(cases, got)} == cases
    assert on(titles.is_keep, "Chapter 1", "Notes") == [True, False]
    assert on(titles.is_skip, "Chapter 1", "Notes") == [False, True]


def test_names_and_space(on):
    assert on(text.slug, "My Book!", "  --A  b-- ", "Ёж 12") == ["my-book", "a-b", "ёж-12"]
    assert on(text.collapsed, " a \n\t b ", " a ") == ["a b", "a"]
    assert on(text.basename, "a/b\\c.x", "c.x", "a/") == ["c.x", "c.x", ""]
    assert [tuple(r) for r in on(text.split_anchor, "f.html#a#b", "f.html")] == [("f.html", "a#b"), ("f.html", "")]
    resolve = lambda c: text.resolve_href(F.lit("OEBPS/text"), c)
    assert on(resolve, "../a.png#x", "./b", "../../../c") == ["OEBPS/a.png", "OEBPS/text/b", "../c"]
    assert on(lambda c: text.resolve_href(F.lit(""), c), "x/../y", "y") == ["y", "y"]
    assert on(text.space_split, "a  b ", "") == [["a", "b"], []]
    assert on(text.bitrate, "", "192", "96K", None) == ["128k", "192k", "96K", "128k"]


def test_title_repeated(on):
    cases = {"T\n\nT\n\nbody": "T\n\nbody", "T\nT": "T", "T\n\nbody": "T\n\nbody", "single": "single", "": "", "\nT\nT": "\nT\nT", "T\n\n \n T \n\n\nb": "T\n\nb", "T\n": "T\n"}
    assert on(text.title_deduplicated, *cases) == list(cases.values())


def test_tags_and_logs(on):
    assert on(text.without_tags, "<p>a</p>b", "a > b", "a <open", "<<x>y>") == ["ab", "a  b", "a ", "y"]
    assert on(text.without_colors, "\x1b[33m[WARN]\x1b[0m x", "\x1b[3") == ["[WARN] x", "\x1b[3"]
    assert on(text.log_snippet, "bad for text '<speak><s>Hello there</s>...', gone", "nothing", f"for text '{'x' * 50}'") == ["Hello there...", "", "x" * 40]


def test_sentences(on):
    assert on(text.paragraphs, "a\n\nb\nc\n\n \n\n", "a\nb", "a", " ") == [["a", "b\nc"], ["a", "b"], ["a"], []]
    assert on(text.sentences, "Он? Да! «Нет.» Всё…", "no end", "?!", "a... b") == [["Он?", "Да!", "«Нет.»", "Всё…"], ["no end"], ["?", "!"], ["a.", ".", ".", "b"]]
    assert on(text.stress_sentences, "One. Two!\nThree", " ", "a") == [["One.", "Two!", "Three"], [], ["a"]]


def test_letters(on):
    assert on(text.has_valid_stress, "к+едр", "к+др", "а+", "") == [True, False, False, False]
    assert on(text.sanitized_stress, "М+С фамил+ьяр к+едр", "а+") == ["МС фамильяр к+едр", "а"]
    assert on(text.latin_words, "да DNA и abc, DNA; mixedда", "нет") == [["DNA", "abc", "mixedда"], []]
    assert on(text.bad_symbols, "漢字 и é ñ abc 漢", "да") == [["é", "ñ", "字", "漢"], []]
    assert on(text.without_bad_symbols, "a漢б 1.", "é") == ["aб 1.", ""]
    assert on(text.is_acronym, "DNA", "D", "DNa", "DNA\n") == [True, False, False, False]
    assert on(text.without_combining, "и́е") == "ие"


def test_word_replacement(on):
    f = lambda c: text.word_replaced(c, "замок", "з+амок")
    assert on(f, "Замок и замок.", "замок2 подзамок", "«замок»") == ["з+амок и з+амок.", "замок2 подзамок", "«з+амок»"]
    assert on(lambda c: text.word_replaced(c, "a.b", "x$1\\"), "a.b axb A.B") == "x$1\\ axb x$1\\"
    assert on(lambda c: text.vocabulary_applied(c, [("б а", "б +а"), ("а", "+а"), ("", "x"), ("б", "б")]), "б а") == "б ++а"


def test_transliteration(on):
    assert on(ssml.transliterated, "DNA тест", "GPS", "Hello", "Jazz", "да", "I я") == ["ДЭ ЭН А  тест", "ГЭ ПЭ ЭС ", "Нелло", "ДЖазз", "да", "И я"]
    assert on(ssml.escaped, "<A&b>", "Fg") == ["&lt;А&amp;в&gt;", "Fg"]


def test_generated(on):
    assert on(ssml.generated, "", "Да. Нет!", "a\n\nб") == ["<speak></speak>", "<speak>\n<p><s>Да.</s><s>Нет!</s></p>\n</speak>", "<speak>\n<p><s>а</s></p>\n<p><s>б</s></p>\n</speak>"]


def plain(parts):
    import re

    return re.sub(r"\s+", "", re.sub("<[^>]*>", "", "".join(parts)))


def test_chunks(on):
    assert on(chunks.chunked, "<speak><s>a</s></speak>") == ["<speak><s>a</s></speak>"]
    many = "<speak>" + "".join(f"<s>Sentence {i} {'я' * 40}.</s>" for i in range(60)) + "</speak>"
    parts = on(chunks.chunked, many)
    assert all(len(p.encode()) <= chunks.LIMIT for p in parts) and len(parts) > 3
    assert "".join(p.removeprefix("<speak>").removesuffix("</speak>") for p in parts) == many[7:-8]
    long_ = "<speak><s>a</s><s>" + " ".join(["word"] * 500) + "</s><s>b</s></speak>"
    parts = on(chunks.chunked, long_)
    assert all(len(p.encode()) <= chunks.LIMIT for p in parts) and plain(parts) == plain([long_])
    word = "<speak><s>" + "x" * 2000 + "</s></speak>"
    assert on(chunks.chunked, word) == [word]
    raw = "a" * 500 + ". " + "b" * 600 + "! c"
    assert on(chunks.chunked, raw) == ["a" * 500 + ".", " " + "b" * 600 + "! c"]
    assert on(chunks.marked_sentences, "<s x='1'>a</s><s>b</s>", "<s>a</s><s x='1'>b</s>", "none") == [["<s>b</s>"], ["<s>a</s>", "<s x='1'>b</s>"], []]


def test_byte_prefix(on):
    assert on(lambda c: text.byte_prefix(c, 5), "абвг", "abcde", "abcdef", "a😀b😀") == ["аб...", "abcde", "abcde...", "a😀..."]


def test_ids(on):
    assert on(lambda c: text.chapter_of(c, "analyze"), "analyze-chapter-300", "analyze-chapter-7x", "translate-chapter-1", "x") == [300, 7, 0, 0]
    assert on(lambda c: text.choice(c, F.lit(3)), "2", "3 x", "4", "x") == [2, 3, None, None]


def test_audio(spark):
    a, b = audio.wav(np.arange(10)), audio.wav(np.arange(5))
    both = audio.concatenated([a, b])
    assert both[44:] == a[44:] + b[44:] and struct.unpack_from("<I", both, 40)[0] == 30 and struct.unpack_from("<I", both, 4)[0] == len(both) - 8
    assert audio.concatenated([a]) == a
    with pytest.raises(ValueError):
        audio.concatenated([])
    with pytest.raises(ValueError):
        audio.header(b"x" * 50)
    padded = a[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + a[12:]
    assert audio.header(padded)[1] == a[44:]
    import wave

    with wave.open(io.BytesIO(both)) as w:
        assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (1, audio.RATE, 15)
    rows = [(k, c, audio.wav(np.full(k + 1, c))) for k in range(3) for c in (2, 0, 1)]
    out = audio.joined_audio(spark.createDataFrame(rows, "k long, c int, a binary"), "k", "c", "a").collect()
    assert {r["k"]: np.frombuffer(bytes(r["a"])[44:], "<i2").tolist() for r in out} == {k: [c for c in range(3) for _ in range(k + 1)] for k in range(3)}
    tone = spark.range(1).select(audio.tone(F.lit("x" * 1000)).alias("a"), audio.tone_seconds(F.lit("x" * 10_000)).alias("s")).first()
    assert len(tone["a"]) == 44 + 2 * audio.RATE and tone["s"] == 3.0


def _greedy(sizes, owners, room):
    out, size = [], 0
    for k, (n, o) in enumerate(zip(sizes, owners, strict=True)):
        new = not k or o != owners[k - 1] or size + n > room
        out.append(new)
        size = n if new else size + n
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packs_by_successors(seed):
    """The path along successors is what packing item by item gives, for many owners at once, with items beyond the room."""
    import random

    import numpy as np

    rng = random.Random(seed)
    for _ in range(200):
        n, room = rng.randrange(1, 80), rng.choice([1, 5, 20, 1000])
        owners = sorted(rng.randrange(rng.choice([1, 6])) for _ in range(n))
        sizes = [rng.choice([0, 1, 3, 7, 30]) for _ in range(n)]
        assert chunks.pack_starts(np.array(sizes), np.array(owners), room).tolist() == _greedy(sizes, owners, room)


def test_chunk_edges(on):
    """Sentences that just fit and just do not, sentences that are too long between others, nulls and texts without marks."""
    s = lambda n: "<s>" + "x" * (n - 7) + "</s>"
    doc = lambda *parts: "<speak>" + "".join(parts) + "</speak>"
    assert on(chunks.chunked, doc(s(400), s(485), s(8))) == [doc(s(400), s(485)), doc(s(8))]
    assert on(chunks.chunked, doc(s(400), s(486), s(8))) == [doc(s(400)), doc(s(486), s(8))]
    words = " ".join(["word"] * 300)
    cut = on(chunks.chunked, doc(s(20), f"<s>{words}</s>", s(30), s(40)))
    assert cut[0] == doc(s(20)) and cut[-1] == doc(s(30), s(40)) and all(len(x) <= 900 for x in cut)
    assert " ".join(x[10:-12] for x in cut[1:-1]) == words and len(cut[1]) == 15 + 7 + 5 * 175 - 1
    assert on(chunks.chunked, None, "", "plain. text") == [None, [""], ["plain. text"]]


def test_recordings_in_segments(spark):
    """Segments and parts, put together in order, are the plainly joined bytes; one chunk passes as it is; errors come from sums."""
    import random

    from lectern.operators import recordings

    rng = random.Random(6)
    wav = lambda n: audio.wav(np.array([rng.randrange(-999, 999) for _ in range(n)]))
    extra = lambda w: w[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + w[12:] + b"tail"
    files = {1: [wav(5), extra(wav(7)), wav(0), wav(900)], 2: [extra(wav(4))], 3: [extra(wav(2)), wav(3)], 4: [wav(50) for _ in range(200)]}
    rows = [(k, c, a) for k, own in files.items() for c, a in enumerate(own)] + [(4, 999, None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, c int, a binary").repartition(3)
    pieces = recordings.segments(df, "k", "c", "a")
    for out, at in ((pieces, 0), (recordings.parts(pieces, "k", 1000), 1)):
        got: dict = {}
        for r in out.orderBy("k", "offset").collect():
            assert len(got.get(r["k"], b"")) == r["offset"]
            got[r["k"]] = got.get(r["k"], b"") + bytes(r["bytes"])
        assert got == {k: audio.concatenated(own) for k, own in files.items()}, at
    assert recordings.parts(pieces, "k", 1000).where("k = 4").count() > 10
    assert recordings.segments(df.where("false"), "k", "c", "a").count() == 0
    assert spark.range(1).select(recordings.little(F.lit(0x01020304))).first()[0] == b"\x04\x03\x02\x01"


def test_audio_without_python(spark):
    """Tones and the parts of a WAV are made row by row, in no batches of Python; they are what plain code makes."""
    from lectern.operators import recordings

    def plain(n: int) -> bytes:
        seconds = int(min(audio.BASE + n / audio.BYTES_PER_SECOND, audio.MOST) * 1e9) / 1e9
        return audio.wav(np.trunc(np.sin(2 * np.pi * audio.FREQUENCY * np.arange(int(seconds * audio.RATE)) / audio.RATE) * audio.LOUDNESS * 32767))

    sizes = [0, 1, 2, 3, 7, 777, 1000, 4999, 5000, 5001, 90_000]
    tones = spark.createDataFrame([("x" * n,) for n in sizes] + [(None,)], "t string").select(audio.tone(F.col("t")).alias("a"))
    assert [bytes(r["a"]) for r in tones.collect()] == [plain(n) for n in [*sizes, 0]]

    base, part = audio.wav(np.arange(9)), lambda n: b"LIST" + struct.pack("<I", n) + b"z" * (n + n % 2)
    files = [base, base + b"tail", base[:-3], *(base[:12] + b"".join(part(n) for n in range(k)) + base[12:] for k in (1, 6, 7, 8, 9, 60))]
    split = recordings.parsed(spark.createDataFrame([(k, f) for k, f in enumerate(files)], "k int, a binary"), "a")
    got = {r["k"]: (bytes(r["head"]), bytes(r["data"]), bytes(r["rest"])) for r in split.collect()}
    for k, f in enumerate(files):
        assert got[k][:2] == audio.header(f) and b"".join(got[k]) == f
    for frame in (tones, split):
        assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()
    large = base[:12] + b"LIST" + struct.pack("<I", 1 << 31) + base[12:]
    for bad, why in ((b"RIFF", "too short for WAV: 4 bytes"), (b"x" * 50, "not WAV"), (base[:36] + b"none" + base[40:], "no audio in WAV"), (large, f"chunk too large: {1 << 31}")):
        with pytest.raises(ValueError, match=why):
            audio.header(bad)
        with pytest.raises(Exception, match=why):
            recordings.parsed(spark.createDataFrame([(bad,)], "a binary"), "a").collect()


def test_batches_in_slices():
    """Functions on texts take a batch in pieces of bounded bytes; the answers are those of the whole batch."""
    import pyarrow as pa

    from lectern import shared

    seen = []
    texts = pa.array(["x" * 1000, None, "é. b"] * 5000)
    back = shared.sliced(lambda t: seen.append(t) or pa.array(t.to_pylist(), pa.string()), pa.string(), texts)
    assert back.equals(texts) and len(seen) > 4 and max(t.nbytes for t in seen) < 2 * shared.SLICE
    assert len(shared.sliced(lambda t: t, pa.string(), texts[:0])) == 0 and shared.sliced(lambda t: t, pa.string(), texts[:1]).equals(texts[:1])


def test_speech_in_rounds(spark, monkeypatch):
    """Texts beyond what the tasks of requests take at a time go in rounds; every chapter comes once, as in one round."""
    from lectern.streaming import speech

    rows = spark.createDataFrame([(k, "<speak><s>" + "да. " * k + "</s></speak>") for k in range(40)], "chapter_id long, ssml string")
    config = speech.EngineConfig(voice="v", server_url="http://localhost", parallel=2)
    say = lambda text, _: audio.wav(np.frombuffer(text.encode(), np.uint8).astype(np.int16))
    made = lambda: {r["chapter_id"]: bytes(r["audio"]) for r in speech.engine("http", config, client=say)(rows).collect()}
    whole, jobs = made(), []
    monkeypatch.setattr(speech, "ROUND", 1000)
    keep = speech.kept
    monkeypatch.setattr(speech, "kept", lambda df: jobs.append(df) or keep(df))
    assert made() == whole and len(whole) == 40 and len(jobs) > 2
