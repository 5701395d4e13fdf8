"""Mixing, secrets, quality, passages and near duplicates against plain computations."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import mix, near_dup, passages, quality, secrets

# ---- mixing


def plain_targets(sizes: dict, share=1.0, most=3.0, weights=(1, 2, 3)):
    """Excess dealt out again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in open_)
        now = {s: left * w[s] / total for s in open_}
        full = {s for s in open_ if now[s] > most * sizes[s]}
        if not full:
            return target | now
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
        if not open_:
            return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(df):
    rows = mix.mix(df).collect()
    source = defaultdict(int)
    for r in df.collect():
        source[r["source"]] += words(r["text"])
    want, taken = plain_targets(source), defaultdict(int)
    assert len(rows) == df.count()
    for r in rows:
        assert r["source_size"] == source[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in source:
        assert taken[s] == round(want[s]) or abs(taken[s] - want[s]) <= 0.5
    return rows


def test_mix(spark, edge, documents, sf):
    check_mix(spark.read.parquet(f"{sf}/documents.parquet"))
    check_mix(edge)
    rng = random.Random(1)
    hot = documents([(i, "w " * rng.randrange(40), rng.choice(["a"] * 8 + ["b", "cé", "漢", None])) for i in range(6000)])
    first = sorted(check_mix(hot), key=lambda r: r["doc_id"])
    assert sorted(mix.mix(hot.repartition(7)).collect(), key=lambda r: r["doc_id"]) == first
    assert mix.mix(hot.where("false")).count() == 0
    assert {r["taken"] for r in mix.mix(documents([(1, None), (2, " ")])).collect()} == {0}


def test_sizes_by_range(documents, monkeypatch):
    monkeypatch.setattr(mix, "RANGE_ROWS", 7)
    monkeypatch.setattr(mix, "STRETCH", 7)
    check_mix(documents([(i, "w " * (i % 9), "abc"[i % 3]) for i in range(300)]))


def test_equal_rows_and_many_sources(spark, documents, monkeypatch):
    """A row that is a third of all, and as many sources as documents; batches of copies are dealt out."""
    monkeypatch.setattr(mix, "COPIES", 10)
    monkeypatch.setattr(mix, "RANGE_ROWS", 16)
    monkeypatch.setattr(mix, "STRETCH", 5)
    rows = [(1, "w " * 5, "a")] * 200 + [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(300)] + [(None, "w w", None)] * 7
    df = documents(rows)
    first = sorted(check_mix(df), key=str)
    assert sorted(check_mix(df.repartition(5)), key=str) == first
    check_mix(documents([(i, "w " * (1 + i % 5), f"s{i * 7919 % 1000:04d}") for i in range(400)]))
    out = defaultdict(int)
    for r in mix.mixed_rows(df).collect():
        out[r["doc_id"], r["text"], r["source"]] += 1
    plan = defaultdict(int)
    for r in mix.mix(df, boundary="document").collect():
        plan[r["doc_id"], "w " * r["size"] if r["doc_id"] is not None else "w w", r["source"]] += r["copies"]
    assert dict(out) == {k: c for k, c in plan.items() if c}
    words_taken, want = defaultdict(int), plain_targets({"a": 1000 + sum(i % 9 for i in range(0, 300, 3)), "b": sum(i % 9 for i in range(1, 300, 3)), "c": sum(i % 9 for i in range(2, 300, 3)), None: 14})
    for (_, t, s), c in out.items():
        words_taken[s] += words(t) * c
    assert all(-0.5 <= words_taken[s] - want[s] < 9 for s in want)


def test_mixed_rows(documents):
    df = documents([(i, f"w{i} " * 10, "a" if i < 90 else "b") for i in range(100)])
    rows = mix.mixed_rows(df).collect()
    count = defaultdict(int)
    for r in rows:
        count[r["doc_id"]] += 1
    plan = {r["doc_id"]: r["copies"] for r in mix.mix(df, boundary="document").collect()}
    assert dict(count) == {i: c for i, c in plan.items() if c} and set(rows[0].asDict()) == set(df.columns)
    assert sum(count[i] for i in range(90, 100)) == 30


def test_mixed_rows_of_odd_tables(edge, documents):
    out = [r["doc_id"] for r in mix.mixed_rows(edge).collect()]
    assert out and set(out) <= {3, 4, None, 6, 7} and mix.mixed_rows(edge).columns == edge.columns  # rows without words are left out
    assert mix.mixed_rows(edge.where("false")).count() == 0 == mix.mixed_rows(documents([(1, None), (2, " ")])).count()


# ---- secrets


def plain_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PARTS = ["token=", "Password: ", "apikey", "api_key='", "secret", ":", "=", '"', " ", "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeefdeadbeef", "x" * 7, "ſecret=", "\n\n", "user=", "bob12", "https://h.x/y", "Zx9Kq2Lm4Np6Rs8T", "é", "漢"]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        assert secrets.digest(secrets.base_spans(text)) == plain_base(text), text


def test_linking():
    kinds = lambda t: [s[2] for s in secrets.scan(t)[1]]
    key, mixed = "AKIA" + "A" * 16, "Zx9Kq2Lm4Np6Rs8T"
    assert kinds(f"user=bob\n{mixed}") == [] and kinds(mixed) == [] and kinds("see https://x.y/z") == []
    assert kinds(f"{key} {mixed}") == ["weak_secret"]
    assert kinds(f"{key}\n\n{mixed}") == [], "another scope"
    far = f"{key}{" " * 300}{mixed}"
    assert kinds(far) == ["weak_secret"], "one scope"
    assert secrets.scan(far, 256)[1] == [], "too far for a window"
    assert sorted(kinds(f"user=bob {mixed} https://x.y")) == ["endpoint", "weak_id", "weak_secret"]
    assert kinds("user=bob token=abcdef1") == ["weak_id"]
    assert kinds(f"{key} token=abcdef1 https://x.y") == ["endpoint"]
    assert secrets.redact("a token=abcdef1 b", secrets.scan("a token=abcdef1 b")[0]) == "a [assign] b"


def test_linking_measures_gaps():
    kinds = lambda t: [s[2] for s in secrets.scan(t)[1]]
    long = "Zx9" * 100
    assert kinds(f"token={long} user=bob") == ["weak_id"] == kinds(f"user=bob token={long}")
    assert sorted(kinds(f"user=bob {long} https://x.y")) == ["endpoint", "weak_id", "weak_secret"]
    assert kinds(f"token={long}\n\nuser=bob") == [], "another scope"
    blank = lambda n: f"token={long}{' ' * n}user=bob"
    assert kinds(blank(257)) == ["weak_id"], "one scope"
    assert secrets.scan(blank(256), 256)[1] and not secrets.scan(blank(257), 256)[1]


def plain_links(text, window):
    """All pairs of parts, and all groups around each part."""
    base = secrets.base_spans(text)
    weak = secrets.weak_candidates(text, base)
    parts = [*base, *weak]
    free = [True] * (len(text) + 1)
    for a, b, _ in parts:
        free[a:b] = [False] * (b - a)
    scope = lambda p: sum(m.end() <= p[0] for m in secrets.BLANK_LINE.finditer(text))

    def near(p, q):
        a, b = sorted([p, q])
        return scope(p) == scope(q) and (window is None or sum(free[a[1] : b[0]]) <= window)

    out = set()
    for p in parts:
        around = lambda *kinds: {q for q in parts if q != p and q[2] in kinds and near(p, q)}  # noqa: B023, E731
        groups = []
        if p[2] == "weak_id":
            groups.append([around("assign", "hex")])
        if p[2] == "weak_secret":
            groups.append([around("access")])
        ids, keys, ends = around("access", "weak_id"), around("assign", "hex", "weak_secret"), around("endpoint")
        groups.append([ids, keys] if p[2] == "endpoint" else [ends, keys if p[2] in ("access", "weak_id") else ids])
        for g in groups:
            if all(g):
                out |= {p}.union(*g)
    return {p for p in out if p in weak}


def test_links_by_brute_force():
    rng, some = random.Random(16), 0
    more = ["AKIA" + "A" * 16 + " ", "Zx9Kq2Lm4Np6Rs8T ", "user=bob12 ", "https://h.x/y ", "token=abcdefgh ", "0123456789abcdef" * 2 + " ", " " * 9, " . . . ", "\n", "\n \n", "login: anna "]
    for k in range(6000):
        text = "".join(rng.choice(more if k % 3 else PARTS) for _ in range(rng.randrange(2, 16)))
        window = rng.choice([0, 5, 20, 256, None])
        got_ = secrets.scan(text, window)[1]
        assert set(got_) == plain_links(text, window) and len(set(got_)) == len(got_), (text, window)
        some += bool(got_)
    assert some > 1000


def test_linking_is_near_linear():
    import time

    text = " ".join(["AKIA" + "A" * 16, "Zx9Kq2Lm4Np6Rs8T", "user=bob", "https://x.y"] * 10_000)
    begun = time.process_time()
    assert len(secrets.scan(text)[1]) == 30_000  # every weak part has its complements
    assert time.process_time() - begun < 20


def test_secret_query(edge, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.scan_documents(docs).collect():
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(base.count(k) for k in ("assign:", "access:", "hex:"))
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert secrets.scan_documents(edge).count() == 9 and secrets.scan_documents(edge.where("false")).count() == 0
    cleaned = secrets.redacted_documents(edge)
    assert cleaned.columns == edge.columns and sorted(map(str, cleaned.collect())) == sorted(map(str, edge.collect()))


# ---- quality


def test_ordinal_fit():
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 1500)
    marks = np.array([10, 20, 30])
    rows = [np.unique(np.concatenate([rng.integers(100, 5000, 30), marks[g : g + 1] if rng.random() < 0.9 else []]).astype(np.int32)) for g in grades]
    model = quality.fit(rows[:1000], grades[:1000])
    scores = np.array([model.score(r) for r in rows[1000:]])
    assert model.thresholds[0] < model.thresholds[1]
    means = [scores[grades[1000:] == g, 0].mean() for g in range(3)]
    assert means[0] + 0.3 < means[1] and means[1] + 0.3 < means[2]
    assert quality.fit([], np.zeros(0)).score(np.array([1, 2])) == (0.0, 1.0)


def test_quality_query(spark, edge, documents):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_model(docs, labels)
    again = quality.fit_model(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights)
    scored = quality.grade_documents(docs, model).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in scored if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in scored if r["toxic"] == 1]
    assert sum(clean) / len(clean) > 0.98 and sum(bad) / len(bad) < 0.1
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in scored)
    assert quality.grade_documents(edge, model).count() == 9
    assert quality.accepted(edge, model).columns == edge.columns
    none = quality.fit_model(edge, labels.where("false"))
    assert quality.accepted(edge, none).count() == 9
    small = spark.createDataFrame([(i, i % 3 != 1, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic int".replace("int", "boolean")).selectExpr("doc_id", "int(quality) AS quality", "int(toxic) AS toxic")
    hot = documents([(i, ["awful", "low low", "good words"][i % 3] + f" {i}") for i in range(60)] + [(1, f"text {k}") for k in range(500)])
    rated = quality.sample_rows(hot, small.union(small.where("doc_id = 5")), 61)
    assert [(i, g) for i, g, _ in rated] == sorted([(i, i % 3) for i in range(60)] + [(5, 2)])
    assert rated == quality.sample_rows(hot.repartition(6), small.union(small.where("doc_id = 5")), 61)
    graded = {r["doc_id"]: r["expected_grade"] for r in quality.grade_documents(hot, quality.fit_model(hot, small)).where("doc_id <> 1").collect()}
    assert max(graded[i] for i in range(0, 60, 3)) < min(graded[i] for i in range(4, 60, 3)) and max(graded[i] for i in range(4, 60, 3)) < min(graded[i] for i in range(2, 60, 3))
    odd = spark.createDataFrame([(3, 1, None), (None, 1, 1), (3, 1, 0), (3, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.grade_documents(edge, quality.fit_model(edge, odd)).count() == 9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    scored = quality.grade_documents(docs, quality.fit_model(docs, train)).join(test, "doc_id").collect()
    rate = lambda keep: (lambda x: sum(x) / len(x))([r["kept"] for r in scored if keep(r)])
    assert rate(lambda r: r["quality"] == 1 and r["toxic"] == 0) > 0.99
    assert rate(lambda r: r["toxic"] == 1) < 0.05 and rate(lambda r: r["quality"] == 0 and r["toxic"] == 0) < 0.08


# ---- passages


def test_gear_is_the_rolling_hash():
    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    h, out = 0, []
    for b in data.tolist():
        h = ((h << passages.SHIFT) + int(passages._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert passages.gear(data).tolist() == out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_chunks_resist_shifts():
    rng = random.Random(3)
    text = prose(rng, 2000).encode()
    a, b = passages.cuts([text, b"inserted " + text])
    pieces = lambda t, ends: {t[x:y] for x, y in zip([0, *ends], ends)}
    both = pieces(text, a) & pieces(b"inserted " + text, b)
    assert len(both) > 0.95 * len(a) and a[-1] == len(text)
    assert all(passages.WINDOW < y - x <= passages.MOST for x, y in zip(a, a[1:-1]))
    alone = [passages.cuts([t])[0] for t in (text, b"", b"x" * 5000)]
    assert passages.cuts([text, b"", b"x" * 5000]) == alone and alone[1] == []


def test_cuts_do_not_depend_on_neighbours():
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(1, 40)).encode() for _ in range(400)] + [b"", b"", b"a"]
    assert passages.cuts(texts) == [passages.cuts([t])[0] for t in texts]
    assert passages.cuts(texts[::-1]) == passages.cuts(texts)[::-1] and passages.cuts([]) == []


def plain_cuts(data):
    """By the definition, byte by byte."""
    h, hashes = 0, []
    for b in data:
        h = ((h << passages.SHIFT) + int(passages._GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    w, ends = passages.WINDOW, []
    for i, x in enumerate(hashes):
        if x > max(hashes[max(0, i - w) : i], default=0) and x >= max(hashes[i + 1 : i + 1 + w], default=0):
            ends.append(i + 1)
    out, last = [], 0
    for e in [*ends, len(data)]:
        while e - last > passages.MOST:
            last += passages.MOST
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def plain_passages(rows, least):
    texts = {(i, (t or "").encode()) for i, t in rows}
    key = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    split = {x: [(a, b, x[1][a:b]) for c in [plain_cuts(x[1])] for a, b in zip([0, *c], c)] for x in texts}
    for (i, _), pieces in split.items():
        for _, _, piece in pieces:
            holders[piece].add(key(i))
    out = []
    for (i, t), pieces in split.items():
        run = []
        for a, b, piece in [*pieces, (-1, -1, None)]:
            if piece is not None and len(holders[piece]) > 1:
                run.append((a, b, min(holders[piece])))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                at = 0
                for k in range(1, len(run) + 1):
                    if k == len(run) or run[k][2] != run[at][2]:
                        out.append((i, t, run[at][0], run[k - 1][1], run[at][2], run[at][2] == key(i)))
                        at = k
            run = []
    return sorted(out, key=str)


def found_passages(df, least):
    texts = defaultdict(set)
    for r in df.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(text) AS h").collect():
        texts[r["doc_id"], r["h"]].add(r["text"].encode())
    key = lambda i: (i is None, i or 0)
    rows = passages.repeated_passages(df, least).collect()
    return sorted(((r["doc_id"], *texts[r["doc_id"], r["text_hash"]], r["start"], r["end"], key(r["first_doc_id"]), r["is_first"]) for r in rows), key=str)


def test_cuts_by_definition():
    rng = random.Random(11)
    for text in [prose(rng, 300).encode(), b"ab" * 700, b"x" * 40, b"", b"a", "naïve 漢字 😀 ".encode() * 40]:
        assert passages.cuts([text])[0] == plain_cuts(text)


def test_passages(documents, edge, monkeypatch):
    """Overlapping passages, repeated and missing ids with other texts, against brute force; with hot digests too."""
    rng = random.Random(4)
    shared = [prose(rng, 60) for _ in range(12)]
    rows = []
    for i in range(160):
        body = [prose(rng, rng.randrange(20, 60)) for _ in range(2)]
        if i % 2:
            k = rng.randrange(12)
            body.insert(1, " ".join([*shared[k].split(), *shared[(k + 1) % 12].split()][rng.randrange(40) : rng.randrange(70, 120)]))
        rows.append((rng.choice([i, i, i, i % 7, None]), " ".join(body)))
    w = prose(rng, 300).split()
    rows += [(1, " ".join(w[:180])), (5, " ".join(w)), (7, " ".join(w[120:])), (1, " ".join(w[:180])), (9, None), (9, "")]
    for least, hot in ((80, 100_000), (1, 100_000), (80, 3)):
        monkeypatch.setattr(passages, "HOT", hot)
        want = plain_passages(rows, least)
        assert want and found_passages(documents(rows), least) == want
    assert passages.repeated_passages(edge).where("not doc_id in (3, 7)").count() == 0  # the only equal texts
    long_ = documents([(1, "x " * 400), (1, "x " * 400)])
    assert passages.repeated_passages(long_).count() == 0  # repeats inside one document
    assert passages.repeated_passages(edge.where("false")).count() == 0


def test_no_text_is_lost(documents):
    """Without its repeats, every stretch of a corpus is still somewhere."""
    rng = random.Random(14)
    w = prose(rng, 300).split()
    rows = [(1, " ".join(w[:180])), (5, " ".join(w)), (7, " ".join(w[120:])), (8, "é漢" * 200 + " ".join(w)), (9, "é漢" * 200), (None, None), (10, "")]
    out = passages.without_repeats(documents(rows))
    assert out.columns == documents(rows).columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[1] == rows[0][1] and left[None] is None and left[10] == "" and len(left[7]) < 300 and len(left[5]) < 1200
    assert " ".join(w[190:290]) in left[5] and left[8].startswith("é漢" * 200)
    assert passages.remove("aé漢b", [{"start": 2, "end": 5}]) == "aé漢b" and passages.remove("aé漢b", [{"start": 1, "end": 6}]) == "ab"


@pytest.mark.parametrize("words_, most", [(51, 5), (60, 1)])
def test_short_passages_are_found(words_, most):
    rng, missed = random.Random(15), 0
    for _ in range(500):
        p = prose(rng, words_)
        texts = [f"{prose(rng, rng.randrange(20, 60))} {p} {prose(rng, rng.randrange(20, 60))}".encode() for _ in range(2)]
        one, two = ([t[a:b] for a, b in zip([0, *c], c)] for t, c in zip(texts, passages.cuts(texts)))
        best = now = 0
        for piece in one:
            now = now + len(piece) if piece in set(two) else 0
            best = max(best, now)
        missed += best < passages.PASSAGE
    assert missed <= most


# ---- near duplicates


def plain_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    sets = [(i, plain_sets(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))


def near_rows(rng, groups, copies, alone, length=60):
    out = []
    for _ in range(groups):
        base = prose(rng, length).split()
        for _ in range(rng.randrange(2, copies)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice("xyz") * 3
            out.append(" ".join(w).title() if rng.random() < 0.3 else " ".join(w))
    out += [prose(rng, rng.randrange(1, length)) for _ in range(alone)]
    rng.shuffle(out)
    return list(enumerate(out, 100))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect())


def test_near_duplicates(documents):
    rng = random.Random(6)
    rows = near_rows(rng, 12, 9, 60)
    rows += [(5000 + k, t) for k, t in enumerate([None, "", "  \n", "one", "one", "ONE", "one two three", "One two  three", "a b c d", "a b c e"])] + rows[:3]
    assert got(documents(rows)) == plain_components(rows)
    assert near_dup.near_duplicates(documents([])).count() == 0
    assert got(documents([(1, None)])) == [(1, 0, 1, True)]
    null = near_dup.near_duplicates(documents([(None, "a b c d e f"), (7, "a b c d e f")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in null} == {(None, 7), (7, 7)}


def test_branching_and_huge_groups(documents, monkeypatch):
    """Tiny limits send the same documents through leaders, branching and confirmation node by node."""
    rng = random.Random(7)
    rows = near_rows(rng, 3, 40, 20, 40)
    passage = prose(rng, 30)
    rows += [(9000 + k, passage + " " + prose(rng, 40)) for k in range(60)]
    want = plain_components(rows)
    monkeypatch.setattr(near_dup, "SMALL", 6)
    monkeypatch.setattr(near_dup, "GROUP", 5)
    for levels in (1, 3):  # what is still large is compared in pairs of blocks
        monkeypatch.setattr(near_dup, "LEVELS", levels)
        assert got(documents(rows)) == want


def test_reach():
    rng = np.random.default_rng(5)
    base = np.arange(100, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(100)[: int(rng.integers(60, 101))]], rng.integers(1000, 5000, 3).astype(np.uint64)])) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    signatures = (near_dup.mixed(np.stack([near_dup.embedding(s) for s in sets])) >> np.uint64(56)).astype(np.uint8)
    root = near_dup.reach(sizes, signatures, sets)
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (sizes[a] + sizes[b] - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert root.tolist() == [find(k) for k in range(60)]


def test_one_of_each(documents):
    rng = random.Random(8)
    rows = near_rows(rng, 5, 6, 10) + [(1, None), (2, "")]
    df = documents(rows)
    kept = {r["doc_id"] for r in near_dup.one_of_each(df).collect()}
    assert kept == {i for i, _, c, k in plain_components(rows) if k}
    twice = documents(rows[:4] + rows[:1])
    assert near_dup.one_of_each(twice).count() == len({c for _, _, c, _ in plain_components(rows[:4])})
    assert near_dup.one_of_each(df).columns == df.columns


def test_ids_with_several_texts(documents):
    """Rows of one doc_id are judged by their own texts: no text that is unlike all others is lost."""
    rng = random.Random(12)
    rows = near_rows(rng, 6, 7, 12, 40)
    rows = [(i % 11 if rng.random() < 0.6 else i if rng.random() < 0.8 else None, t) for i, t in rows]
    rows += rows[:5] + [(3, None), (3, ""), (3, "")]
    left = [(r["doc_id"], r["text"]) for r in near_dup.one_of_each(documents(rows)).collect()]
    by_row = plain_components([(k, t) for k, (_, t) in enumerate(rows)])
    text_of = {k: t for k, (_, t) in enumerate(rows)}
    part = {k: c for k, _, c, _ in by_row}
    named = defaultdict(list)  # rows without an id take part by equal sets only
    for k, (i, t) in enumerate(rows):
        named[part[k]].append((i, t))
    assert sum(not plain_sets(t) for _, t in left) == sum(not plain_sets(t) for _, t in rows)
    for members in named.values():
        ids = [i for i, t in members if i is not None and plain_sets(t)]
        if ids:
            mine = [x for x in left if x[0] is not None and x in members]
            assert len(mine) == 1 and mine[0][0] == min(ids)
    sets = {plain_sets(t) for i, t in rows if i is not None}
    for s in {plain_sets(t) for i, t in rows if i is None} - {frozenset()}:
        assert sum(i is None and plain_sets(t) == s for i, t in left) == (s not in sets)
    two = near_dup.one_of_each(documents([(3, prose(rng, 30)), (3, prose(rng, 30))]))
    assert two.count() == 2
    assert {r["component_id"] for r in near_dup.near_duplicates(documents(rows)).where("doc_id = 3").collect()} <= {i for i, _ in rows if i is not None}


def test_recall_at_the_threshold(documents):
    """Pairs of similarity 0.75 to 0.8, all alone in the corpus: each is found."""
    rng, rows, want = random.Random(13), [], 0
    for k in range(700):
        w = prose(rng, 84).split()
        v = list(w)
        v[rng.randrange(5, 40)] = v[rng.randrange(50, 79)] = "changed"
        x, y = plain_sets(" ".join(w)), plain_sets(" ".join(v))
        want += 0.75 <= len(x & y) / len(x | y) <= 0.82
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert want == 700
    assert sum(r["component_id"] == r["doc_id"] for r in near_dup.near_duplicates(documents(rows)).collect()) == 700


def test_groups_above_the_node_size(documents, monkeypatch):
    """Copies that agree with their node's leaders: links through leaders are confirmed too, in nodes that do not branch."""
    rng = random.Random(9)
    rows = []
    for g in range(2):
        base = prose(rng, 120).split()
        for k in range(60):
            w = list(base)
            w[(2 * k + g) % 120] = "changed"
            rows.append((1000 * g + k, " ".join(w)))
    rows += list(enumerate((prose(rng, 50) for _ in range(20)), 5000))
    monkeypatch.setattr(near_dup, "SMALL", 16)
    monkeypatch.setattr(near_dup, "GROUP", 16)
    assert got(documents(rows)) == plain_components(rows)
