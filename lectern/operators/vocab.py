"""Vocabularies: keyed merges that keep what came first, tags by chapter, conflicts, overrides.

Keys compare in lower case. Tables that are merged carry ``ord``, the place of a row; earlier rows win. Merges are
groupings with partial aggregates, so no key's rows are gathered in one place unless a list of them is the result.
"""

from __future__ import annotations

import heapq
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_valid_stress, without_combining
from .scan import numbered


def sided(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables, existing rows in front: place is (side, ord)."""
    tag = lambda df, k: df.withColumn("side", F.lit(k))
    return tag(existing, 0).unionByName(tag(new, 1), allowMissingColumns=True)


def first_rows(df: DataFrame, key: Column, place: Column) -> DataFrame:
    """The row of the least place for each key."""
    whole = F.struct(*df.columns)
    return df.groupBy(key.alias("__key")).agg(F.min_by(whole, place).alias("r")).select("r.*")


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def chapters_of(found: DataFrame, existing: DataFrame, name: str) -> DataFrame:
    """(key, chapters): distinct chapters of each name, those found now in their order, then those it had.

    found: name, chapter_id, ord; existing: name, chapters, ord."""
    now = found.where(F.col(name) != "").select(F.lower(name).alias("key"), F.struct(F.lit(0).alias("side"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("k"), F.col("chapter_id").cast("int").alias("id")).alias("x"))
    had = existing.where(F.col(name) != "").select(F.lower(name).alias("key"), "ord", F.posexplode("chapters").alias("k", "id"))
    had = had.select("key", F.struct(F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord"), F.col("k"), F.col("id").cast("int").alias("id")).alias("x"))
    # A chapter counts once for a key and side, so lists stay as short as the number of chapters.
    once = now.unionByName(had).groupBy("key", F.col("x.id").alias("id")).agg(F.min("x").alias("x"))
    return once.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias("chapters"))


def tagged(rows: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """rows with the chapters of tags (key, chapters); rows without keep their own."""
    t = tags.select("key", F.col("chapters").alias("found"))
    joined = rows.withColumn("key", F.lower(name)).join(t, "key", "left")
    return joined.withColumn("chapters", F.coalesce("found", "chapters")).drop("key", "found")


def merged_terms(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Terms of existing, and new ones (with source and target) whose source is not there yet; ``added`` marks these."""
    rows = sided(existing, new.where((F.col("source") != "") & (F.col("target") != "")))
    return first_rows(rows, F.lower("source"), F.struct("side", "ord")).withColumn("added", F.col("side") == 1).drop("side")


def merged_characters(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Characters by name: the first row, its empty fields filled with the first value that is not."""
    rows = sided(existing, new).where((F.col("side") == 0) | (F.col("name") != ""))
    place = F.struct("side", "ord")
    filled = [F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", place)), F.lit("")).alias(c) for c in ("translation", "role", "description")]
    out = rows.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", place).alias("name"), *filled, F.min_by("chapters", place).alias("chapters"), F.min(place).alias("place"))
    return out.select("name", "translation", "role", "description", "chapters", F.col("place.ord").alias("ord"), (F.col("place.side") == 1).alias("added"))


def unique_variants(forms: Column) -> Column:
    """Forms that are not empty, distinct in any case, first spelling kept."""
    kept = F.filter(forms, lambda f: f.isNotNull() & (f != ""))
    lower = F.transform(kept, F.lower)
    return F.filter(F.transform(kept, lambda f, i: F.when(F.array_position(lower, F.lower(f)) == i + 1, f)), lambda f: f.isNotNull())


def merged_stress(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries (merge int: 0 what is stored, then one number for each merge in its order; ord; term; stressed; approved;
    chapters) -> (store, conflicts).

    The first form of a term stays. Of a later merge the first form that differs from it is a conflict (merge, term,
    variants), unless what is stored is approved."""
    rows = entries.where((F.col("merge") == 0) | ((F.col("term") != "") & (F.col("stressed") != ""))).withColumn("key", F.lower("term"))
    place = F.struct("merge", "ord")
    whole = F.struct("term", "stressed", "approved", "chapters")
    base = rows.groupBy("key").agg(F.min_by(whole, place).alias("b"), F.min(place).alias("place"))
    store = base.select("b.*", F.col("place.merge").alias("merge"), F.col("place.ord").alias("ord"))
    other = rows.join(base.select("key", "b"), "key").where((F.col("merge") > 0) & ~F.coalesce("b.approved", F.lit(False)) & (F.lower("stressed") != F.lower("b.stressed")))
    found = other.groupBy("key", "merge").agg(F.min_by(F.struct("term", "stressed", F.col("b.stressed").alias("first")), "ord").alias("c"), F.min("ord").alias("ord"))
    conflicts = found.select("merge", "ord", F.col("c.term").alias("term"), unique_variants(F.array("c.first", "c.stressed")).alias("variants"))
    return store, conflicts


def stored_order(stress: DataFrame) -> DataFrame:
    """Longest terms first, by bytes; ord numbers the new order, by a scan over ranges of it, so that no task holds all entries."""
    rows = numbered(stress.withColumn("__size", -F.octet_length("term")), [], ["__size", "ord"], -1)
    return rows.withColumn("ord", F.col("number").cast("int")).select(*stress.columns).orderBy("ord")


def with_chapter_tags(store: DataFrame, entries: DataFrame) -> DataFrame:
    """store with the chapters added in which entries (chapter_id, term, ord) have the term."""
    tags = chapters_of(entries, store.select("term", "chapters", "ord").where("false"), "term")
    joined = store.withColumn("key", F.lower("term")).join(tags.select("key", F.col("chapters").alias("found")), "key", "left")
    had = F.coalesce("chapters", F.array().cast("array<int>"))
    return joined.withColumn("chapters", F.array_distinct(F.concat(had, F.coalesce("found", F.array().cast("array<int>"))))).drop("key", "found")


def deduplicated_conflicts(conflicts: DataFrame) -> DataFrame:
    """One conflict for each term: its first spelling, all variants in order, distinct in any case."""
    rows = conflicts.select(F.lower("term").alias("key"), "term", "merge", "ord", F.posexplode("variants").alias("k", "variant"))
    place = F.struct("merge", "ord", "k")
    once = rows.groupBy("key", F.lower("variant").alias("v")).agg(F.min_by("variant", place).alias("variant"), F.min(place).alias("place"), F.min_by("term", place).alias("term"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "variant"))), lambda x: x["variant"])
    return once.groupBy("key").agg(F.min_by("term", "place").alias("term"), listed.alias("variants"), F.min("place").alias("p")).select("term", "variants", F.col("p.merge").alias("merge"), F.col("p.ord").alias("ord"))


def resolved(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """store (ord, term, stressed, approved, chapters) after decisions (term, stressed): a form is set and approved, an empty
    form deletes the first entry of the term, an unknown term with a form is added behind."""
    d = decisions.select(F.lower("term").alias("key"), F.col("term").alias("d_term"), F.col("stressed").alias("d_form"))
    rows = store.withColumn("key", F.lower("term"))
    first = rows.groupBy("key").agg(F.min("ord").alias("first"))
    j = rows.join(first, "key").join(d, "key", "left").withColumn("hit", F.col("d_form").isNotNull() & (F.col("ord") == F.col("first")))
    kept = j.where(~F.col("hit") | (F.col("d_form") != ""))
    kept = kept.select("ord", "term", F.when(F.col("hit"), F.col("d_form")).otherwise(F.col("stressed")).alias("stressed"), F.when(F.col("hit"), True).otherwise(F.col("approved")).alias("approved"), "chapters")
    new = d.join(first, "key", "left_anti").where("d_form <> ''")
    # Behind all others, apart from one another where the order has room.
    behind = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("key"), 3) if dict(store.dtypes)["ord"] == "bigint" else F.lit(2**31 - 1)
    added = new.select(behind.alias("ord"), F.col("d_term").alias("term"), F.col("d_form").alias("stressed"), F.lit(True).alias("approved"), F.array().cast("array<int>").alias("chapters"))
    return kept.unionByName(added)


def sanitized(entries: DataFrame) -> DataFrame:
    """Forms without combining marks; those without a valid stress mark are dropped."""
    return entries.withColumn("stressed", without_combining(F.col("stressed"))).where(has_valid_stress(F.col("stressed")))


def with_characters(terms: DataFrame, characters: DataFrame, legacy: bool = False) -> DataFrame:
    """Characters as terms of type character, then the terms that are neither of that type nor in the list already. Tags of
    characters are kept; ``legacy`` drops them, so that they reach no chapter's prompt."""
    chapters = F.array().cast("array<int>") if legacy else F.col("chapters")
    c = characters.where((F.col("name") != "") & (F.col("translation") != ""))
    c = c.select(F.col("name").alias("source"), F.col("translation").alias("target"), F.lit("character").alias("type"), chapters.alias("chapters"), F.lit(0).alias("side"), F.col("ord").cast("long").alias("ord"))
    t = terms.where(F.col("type") != "character").select("source", "target", "type", "chapters", F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord"))
    # Characters that repeat a name all stay; a term goes if its source is a character or an earlier term.
    known = c.select(F.lower("source").alias("key")).distinct()
    fresh = t.withColumn("key", F.lower("source")).join(known, "key", "left_anti").drop("key")
    return c.unionByName(first_rows(fresh, F.lower("source"), F.col("ord")))


def overridden(rows: DataFrame, overrides: DataFrame, name: str, value: str, extra: str | None = None, default: str | None = None) -> DataFrame:
    """rows with the value of the first override (ord, source, target, type) of their name, which may be empty; ``extra`` is
    set too where the override has a type. Overrides with both sides that match no row are added behind."""
    o = overrides.withColumn("key", F.lower("source"))
    first = o.groupBy("key").agg(F.min_by(F.struct("target", "type"), "ord").alias("o"))
    j = rows.withColumn("key", F.lower(name)).join(first, "key", "left")
    out = j.withColumn(value, F.when(F.col("o").isNotNull(), F.col("o.target")).otherwise(F.col(value)))
    if extra:
        out = out.withColumn(extra, F.when(F.coalesce(F.col("o.type"), F.lit("")) != "", F.col("o.type")).otherwise(F.col(extra)))
    out = out.drop("key", "o")
    missing = o.where((F.col("source") != "") & (F.col("target") != "")).join(rows.select(F.lower(name).alias("key")), "key", "left_anti")
    missing = first_rows(missing, F.col("key"), F.col("ord"))
    columns = {c: F.lit(None).cast(t) for c, t in rows.dtypes} | {name: F.col("source"), value: F.col("target")}
    if "ord" in rows.columns:
        columns["ord"] = F.col("ord") + (1 << 61) if dict(rows.dtypes)["ord"] == "bigint" else (F.col("ord") + (1 << 30)).cast("int")
    if extra:
        columns[extra] = F.when(F.coalesce("type", F.lit("")) != "", F.col("type")).otherwise(F.lit(default))
    for c, t in rows.dtypes:
        if t == "string" and c not in (name, value, extra):
            columns[c] = F.lit("")
        elif t.startswith("array"):
            columns[c] = F.array().cast(t)
        elif t == "boolean":
            columns[c] = F.lit(False)
    return out.unionByName(missing.select(*[columns[c].alias(c) for c in rows.columns]))


def looked_up(asked: DataFrame, name: str, vocabulary: DataFrame, key: str) -> DataFrame:
    """asked with the first entry of the vocabulary of its name, in any case; null fields where there is none."""
    first = first_rows(vocabulary, F.lower(key), F.col("ord"))
    return asked.join(first.withColumn("__k", F.lower(key)), F.lower(F.col(name)) == F.col("__k"), "left").drop("__k")


def counts_by_chapter(rows: DataFrame, name: str = "n") -> DataFrame:
    """Entries tagged with each chapter; an entry counts once for a chapter."""
    return rows.select(F.explode(F.array_distinct("chapters")).alias("chapter_id")).groupBy("chapter_id").agg(F.count(F.lit(1)).alias(name))


def processed(chapters: DataFrame, stress: DataFrame, processed_ids: list[int]) -> DataFrame:
    """chapters (id) with ``processed``: listed as such, or tagged by an entry."""
    tags = stress.select(F.explode("chapters").alias("id")).distinct().withColumn("hit", F.lit(True))
    listed = F.col("id").isin(*processed_ids) if processed_ids else F.lit(False)
    return chapters.join(tags, "id", "left").withColumn("processed", listed | F.coalesce("hit", F.lit(False))).drop("hit")


def override_entries(overrides: DataFrame) -> DataFrame:
    """Overrides (ord, term, phonemes) as stress entries, incomplete ones left out, in their own order."""
    return overrides.where((F.col("term") != "") & (F.col("phonemes") != "")).select("ord", "term", F.col("phonemes").alias("stressed"), F.lit(False).alias("approved"), F.array().cast("array<int>").alias("chapters"))


#: Entries of a vocabulary that one pass over the texts applies.
PASS_ENTRIES = 200_000


def applied(rows: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with a vocabulary (ord, term, stressed) of any size applied to their text, entry by entry in its order: whole
    words, in any case. Up to PASS_ENTRIES go along to the texts at once; as entries follow one another, more take more passes."""
    used = entries.where("term <> '' and stressed <> '' and term <> stressed").select("ord", "term", "stressed")
    known = used.count()
    if known <= PASS_ENTRIES:
        return _one_pass(rows, used, text)
    bounds = used.approxQuantile("ord", [k * PASS_ENTRIES / 2 / known for k in range(1, int(2 * known / PASS_ENTRIES) + 1)], 0.001)
    low = None
    for high in [*sorted(set(bounds)), None]:
        part = used if low is None else used.where(F.col("ord") > low)
        rows, low = _one_pass(rows, part if high is None else part.where(F.col("ord") <= high), text), high
    return rows


def _one_pass(rows: DataFrame, entries: DataFrame, text: str) -> DataFrame:
    sent = entries.toArrow().sort_by("ord")
    terms, forms = sent.column("term").to_pylist(), sent.column("stressed").to_pylist()

    def run(batches):
        one = applier(terms, forms)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = [one(t) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


_TOKENS = re.compile(r"[^\W_]+|[\W_]", re.S)


def applier(terms: list[str], forms: list[str]):
    """A function that applies entries to a text in their order, each to the text that those before it left.

    Texts and terms are words and single other characters, so a term stands at word boundaries where its tokens follow one
    another and no word touches its ends. The places of all entries that occur are an agenda by entry; a replacement looks for later entries
    only around what it has put in, so work grows with the text and its occurrences, not with their product."""
    trie: dict = {}
    lengths = []
    for k, term in enumerate(terms):
        node, tokens = trie, _TOKENS.findall(term)
        lengths.append(len(tokens))
        for x in tokens:
            node = node.setdefault(x.lower(), {})
        node.setdefault(None, []).append(k)
    reach = max(lengths, default=1) - 1
    put = [_TOKENS.findall(f) for f in forms]
    is_word = lambda x: x[0] != "_" and x[0].isalnum()

    def apply(text: str) -> str:
        tokens = _TOKENS.findall(text)
        keys = [x.lower() for x in tokens]
        if not any(x in trie for x in keys):
            return text
        # A linked list of tokens; 0 is its head, and its end. A label orders tokens: what replaces some goes under the first one's.
        tokens, keys, labels = ["", *tokens], [None, *keys], [(), *((i,) for i in range(len(tokens)))]
        n = len(tokens)
        after, before, gone = [*range(1, n), 0], [n - 1, *range(n - 1)], [False] * n
        agenda: list[tuple[int, int]] = []

        def look(i: int, least: int) -> None:
            """Puts the entries after ``least`` that stand at token i onto the agenda."""
            node, j = trie, i
            while j and (node := node.get(keys[j])) is not None:
                for k in node.get(None, ()):
                    if k > least:
                        heapq.heappush(agenda, (k, i))
                j = after[j]

        def end(k: int, i: int) -> int | None:
            """The token behind entry k at token i, if it stands there."""
            if gone[i] or (before[i] and not is_word(tokens[i]) and is_word(tokens[before[i]])):
                return None
            node, j = trie, i
            for _ in range(lengths[k]):
                node = node.get(keys[j]) if j else None
                if node is None:
                    return None
                j = after[j]
            last = before[j]
            return j if k in node.get(None, ()) and not (j and not is_word(tokens[last]) and is_word(tokens[j])) else None

        for i in range(1, n):
            if keys[i] in trie:
                look(i, -1)
        while agenda:
            k, places = agenda[0][0], set()
            while agenda and agenda[0][0] == k:
                places.add(heapq.heappop(agenda)[1])
            # All places of an entry are those in the text before it; of places that overlap the first counts.
            found = [(i, j) for i in sorted(places, key=labels.__getitem__) if (j := end(k, i)) is not None]
            regions = []
            for i, j in found:
                if gone[i]:
                    continue
                front, label, x = before[i], labels[i], i
                while x != j:
                    gone[x], x = True, after[x]
                first = last = len(tokens)
                for m, token in enumerate(put[k]):
                    last = first + m
                    tokens.append(token)
                    keys.append(token.lower())
                    labels.append((*label, m))
                    gone.append(False)
                    before.append(last - 1 if m else front)
                    after.append(last + 1)
                after[front], before[first], after[last], before[j] = first, front, j, last
                regions.append((first, last))
            starts = []
            for first, last in regions:
                # Where two replacements touch, their words become one.
                front = before[first]
                if front and is_word(tokens[front]) and is_word(tokens[first]):
                    tokens[front] += tokens[first]
                    keys[front] = tokens[front].lower()
                    gone[first], after[front], before[after[first]] = True, after[first], front
                    first, last = front, front if first == last else last
                starts.append((first, last))
            for first, last in starts:
                x = first
                for _ in range(reach):
                    if not before[x]:
                        break
                    x = before[x]
                stop = after[last]
                while x != stop:
                    if keys[x] in trie:
                        look(x, k)
                    x = after[x]
        out, x = [], after[0]
        while x:
            out.append(tokens[x])
            x = after[x]
        return "".join(out)

    return apply


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
