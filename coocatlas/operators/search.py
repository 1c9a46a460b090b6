"""Keyword search over entity names: documents, word matching, ranking, de-duplication, hit records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coocatlas.functions.let import let
from coocatlas.functions.text import fold_key, parse_search_id, search_id, words
from coocatlas.schema import ENTITIES
from coocatlas.sources.staging import Staging, checkpoint

# Searched fields in order of weight, and word lengths from which one and two typos are allowed.
FIELDS = ("label", "artist_name", "album_name_norm", "track_name_norm")
NAMES_OF = {
    "track": ("track_name_norm", "artist_name"),
    "album": ("album_name_norm", "artist_name"),
    "artist": ("artist_name",),
    "label": ("label",),
}
ONE_TYPO, TWO_TYPOS = 5, 9
FAR = 8
#: A word in more documents than this has its postings in several parts, and at most so many words do.
PART, COMMON = 50_000, 10_000
#: So few word hits of all requests together are scored in one go, which takes fewer jobs for the same rows.
DIRECT = 1_000_000
def _best_first() -> tuple[Column, ...]:
    """Order of the documents that hold equally many leading words of a request."""
    return F.asc("typos"), F.asc("span"), F.desc("logcount"), F.asc("field"), F.desc("exact"), F.asc("id")


def search_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """Searchable rows of all entities as (id, name fields, logcount, lon, lat); absent fields are null."""
    parts = [
        tables[e.table].where("searchable").select(
            search_id(e.name, F.col(e.key)).alias("id"), *NAMES_OF[e.name], "logcount", "lon", "lat"
        )
        for e in ENTITIES
    ]
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return joined.select("id", *FIELDS, "logcount", "lon", "lat")


def postings(documents: DataFrame) -> DataFrame:
    """(word, id, field, at): every word of every searched field with its place."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(FIELDS)])
    return (
        documents.select("id", F.inline(fields))
        .where(F.col("text").isNotNull())
        .select("id", "field", F.posexplode(words(F.col("text"))).alias("at", "word"))
    )


def _query_words(requests: DataFrame) -> DataFrame:
    text = F.when(F.length("text") > 0, F.col("text")).otherwise(F.raise_error(F.lit("search text must not be empty")))
    split = requests.select("request_id", words(text).alias("w"))
    return split.select("request_id", F.size("w").alias("n"), F.posexplode("w").alias("slot", "term")).select(
        "request_id", "slot", "term", (F.col("slot") == F.col("n") - 1).alias("is_last")
    )


def _typo_budget(word: Column) -> Column:
    return F.when(F.length(word) >= TWO_TYPOS, 2).when(F.length(word) >= ONE_TYPO, 1).otherwise(0)


def _shortened(word: Column, depth: Column) -> Column:
    """The word with up to ``depth`` (0, 1 or 2) letters left out.

    Two words within d edits share at least one such string of depth d, which turns
    the distance search into an equi-join.
    """

    def cut(text: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(text))
        return F.transform(
            at, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
        )

    once = cut(word)
    twice = F.flatten(F.transform(once, cut))
    own = F.array(word)
    return F.array_distinct(
        F.when(depth == 2, F.concat(own, once, twice)).when(depth == 1, F.concat(own, once)).otherwise(own)
    )


def spellings(dictionary: DataFrame) -> DataFrame:
    """(variant, word): the shortened forms under which a dictionary word is found."""
    # a word can be as many letters shorter than the shortest term that may reach it as that term has typos
    depth = F.when(F.length("word") >= TWO_TYPOS - 2, 2).when(F.length("word") >= ONE_TYPO - 1, 1).otherwise(0)
    return dictionary.select(F.explode(_shortened(F.col("word"), depth)).alias("variant"), "word")


def prefixes(dictionary: DataFrame) -> DataFrame:
    """(term, word): every beginning of a dictionary word."""
    starts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))
    return dictionary.select(F.explode(starts).alias("term"), "word")


@dataclass(frozen=True)
class SearchIndex:
    """What a search reads: the documents, their postings, two ways into the dictionary, and how common its words are."""

    documents: DataFrame
    postings: DataFrame
    spellings: DataFrame
    prefixes: DataFrame
    frequencies: DataFrame


def word_frequencies(occurrences: DataFrame, part: int = PART) -> DataFrame:
    """(word, docs, parts): documents that hold a word, and the parts its postings are spread over."""
    counts = occurrences.select("word", "id").distinct().groupBy("word").agg(F.count("*").alias("docs"))
    # fewer than COMMON words can be in more than one in COMMON of all (word, document) pairs
    share = counts.agg(F.greatest(F.lit(part), F.floor(F.sum("docs") / COMMON)).alias("_part"))
    return counts.crossJoin(F.broadcast(share)).select(
        "word", "docs", F.ceil(F.col("docs") / F.col("_part")).cast("int").alias("parts"))


def spread_postings(occurrences: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Postings with ``part``, by document, so that those of a common word do not share a task."""
    common = F.broadcast(frequencies.where("parts > 1").select("word", "parts"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    return occurrences.join(common, "word", "left").withColumn("part", part).drop("parts")


def search_index(documents: DataFrame, staging: Staging | None = None, part: int = PART) -> SearchIndex:
    """Index of the given documents, written to ``staging`` if there is one."""
    keep = (lambda name, build: build()) if staging is None else staging.table
    kept = keep("search_documents", lambda: documents)
    frequencies = keep("search_frequencies", lambda: word_frequencies(postings(kept), part))
    return SearchIndex(
        kept, keep("search_postings", lambda: spread_postings(postings(kept), frequencies)),
        keep("search_spellings", lambda: spellings(frequencies.select("word"))),
        keep("search_prefixes", lambda: prefixes(frequencies.select("word"))), frequencies,
    )


def expand_terms(terms: DataFrame, known: DataFrame, starts: DataFrame) -> DataFrame:
    """(term, is_last, word, typos, exact): dictionary words each query term stands for.

    Terms match with up to two typos by length; the last term of a query also matches
    as a prefix. ``terms`` has distinct (term, is_last), ``known`` the spellings and
    ``starts`` the prefixes of the dictionary.
    """
    asked = terms.withColumn("budget", _typo_budget(F.col("term")))
    spelled = asked.withColumn("variant", F.explode(_shortened(F.col("term"), F.col("budget"))))
    distance = F.levenshtein("term", "word")
    fuzzy = (
        spelled.join(known, "variant")
        .where(distance <= F.col("budget"))
        .select("term", "is_last", "word", distance.alias("typos"))
    )
    prefixed = starts.join(asked.where("is_last").select("term", "is_last"), "term").select(
        "term", "is_last", "word", F.lit(0).alias("typos")
    )
    return (
        fuzzy.unionByName(prefixed)
        .groupBy("term", "is_last", "word")
        .agg(F.min("typos").alias("typos"))
        .withColumn("exact", F.col("term") == F.col("word"))
    )


def _occurrences(expansion: DataFrame, index: SearchIndex) -> DataFrame:
    """The postings of expanded words, those of a common word met part by part."""
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = expansion.join(index.frequencies.select("word", "parts"), "word").withColumn("part", parts).drop("parts")
    return asked.join(index.postings, ["word", "part"]).drop("part")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)


def _apart(left: Column, right: Column) -> Column:
    step = right["at"] - left["at"]
    near = F.least(F.abs(step) + F.when(step < 0, 1).otherwise(0), F.lit(FAR))
    return F.when(left["field"] == right["field"], near).otherwise(FAR)


def _nearest(g: Column, h: Column) -> Column:
    return F.array_min(F.flatten(F.transform(g, lambda left: F.transform(h, lambda right: _apart(left, right)))))


def _figures(groups: Column) -> Column:
    """All figures of a document from its hits, an array for each leading word."""
    n = F.size(groups)
    gaps = F.zip_with(F.slice(groups, F.lit(1), n - 1), F.slice(groups, F.lit(2), n - 1), _nearest)
    return F.struct(
        n.alias("matched"),
        _total(F.transform(groups, lambda g: F.array_min(F.transform(g, lambda h: h["typos"])))).alias("typos"),
        _total(gaps).alias("span"),
        F.array_min(F.transform(F.flatten(groups), lambda h: h["field"])).alias("field"),
        _total(F.transform(groups, lambda g: F.exists(g, lambda h: h["exact"]).cast("int"))).alias("exact"),
    )


def score_matches(requests: DataFrame, index: SearchIndex, expansion: DataFrame | None = None) -> DataFrame:
    """(request_id, id, matched, typos, span, field, exact) for documents matching at least the first word.

    ``matched`` counts leading query words found; ``typos`` adds the best per word;
    ``span`` adds the distance between neighbouring query words, 8 at most and across
    fields; ``field`` is the weightiest field hit; ``exact`` counts words found as typed.
    All matches are returned; ``best_matches`` finds the first few with less work.
    """
    asked = _query_words(requests)
    if expansion is None:
        expansion = expand_terms(asked.select("term", "is_last").distinct(), index.spellings, index.prefixes)
    hits = (
        _occurrences(asked.join(expansion, ["term", "is_last"]), index)
        .groupBy("request_id", "id")
        .agg(F.collect_list(F.struct("slot", "field", "at", "typos", "exact")).alias("hits"))
    )
    slots = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["slot"])))
    leading = F.aggregate(slots, F.lit(0), lambda m, slot: F.when(slot == m, m + 1).otherwise(m))

    def by_word(matched: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), matched - 1), lambda slot: F.filter("hits", lambda h: h["slot"] == slot))

    scored = let(leading, lambda m: F.when(m > 0, let(by_word(m), _figures)))
    return hits.select("request_id", "id", scored.alias("s")).where(F.col("s").isNotNull()).select("request_id", "id", "s.*")


def leading_phrases(requests: DataFrame) -> DataFrame:
    """(request_id, matched, phrase, whole): the first 1, 2, ... words of each request, ``whole`` for all of them."""
    text = F.when(F.length("text") > 0, F.col("text")).otherwise(F.raise_error(F.lit("search text must not be empty")))
    split = requests.select("request_id", words(text).alias("w")).where(F.size("w") > 0)
    grown = split.withColumn("matched", F.explode(F.sequence(F.lit(1), F.size("w"))))
    return grown.select(
        "request_id", "matched", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("matched"))).alias("phrase"),
        (F.col("matched") == F.size("w")).alias("whole"),
    )


def rarest_terms(phrases: DataFrame, expansion: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(phrase, whole, term, is_last, docs): per phrase the word with the fewest postings; none if a word is unknown.

    ``phrases`` has distinct (phrase, whole). ``docs`` adds the documents of every
    spelling a word stands for and so bounds the documents that can match the phrase.
    """
    common = expansion.join(frequencies, "word").groupBy("term", "is_last").agg(F.sum("docs").alias("docs"))
    slots = _phrase_words(phrases).join(common, ["term", "is_last"], "left")
    rarest = F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "slot", "term", "is_last")).alias("r")
    return slots.groupBy("phrase", "whole").agg(rarest).where("r.docs > 0").select(
        "phrase", "whole", "r.term", "r.is_last", "r.docs")


def _phrase_words(phrases: DataFrame) -> DataFrame:
    terms = F.split("phrase", " ")
    return phrases.select("phrase", "whole", F.size(terms).alias("n"), F.posexplode(terms).alias("slot", "term")).select(
        "phrase", "whole", "slot", "term", (F.col("whole") & (F.col("slot") == F.col("n") - 1)).alias("is_last"))


def phrase_candidates(rarest: DataFrame, expansion: DataFrame, index: SearchIndex) -> DataFrame:
    """(phrase, whole, id): documents with the rarest word of a phrase; other words of it add none."""
    wanted = expansion.join(rarest.select("term", "is_last").distinct(), ["term", "is_last"])
    found = _occurrences(wanted.select("term", "is_last", "word"), index).select("term", "is_last", "id").distinct()
    return rarest.join(found, ["term", "is_last"]).select("phrase", "whole", "id")


def best_of_phrases(rarest: DataFrame, expansion: DataFrame, index: SearchIndex, k: int) -> DataFrame:
    """(phrase, whole, id, matched, typos, span, field, exact) of the k best documents that hold a whole phrase.

    A candidate's own words are compared with those of the phrase, so that the postings
    of the phrase's common words are never read.
    """
    terms = F.split("phrase", " ")

    def placed(field: int, column: str) -> Column:
        found = F.coalesce(words(F.col(column)), F.array().cast("array<string>"))
        return F.transform(found, lambda w, at: F.struct(F.lit(field).alias("field"), at.alias("at"), w.alias("word")))

    def hits(term: Column, slot: Column, held: Column) -> Column:
        starts = F.col("whole") & (slot == F.size(terms) - 1)

        def hit(h: Column) -> Column:
            distance = F.levenshtein(term, h["word"])
            typos = F.when(starts & F.startswith(h["word"], term), 0).when(distance <= _typo_budget(term), distance)
            return F.struct(h["field"].alias("field"), h["at"].alias("at"), typos.alias("typos"),
                            (term == h["word"]).alias("exact"))

        return F.filter(F.transform(held, hit), lambda h: h["typos"].isNotNull())

    fields = F.concat(*[placed(i, c) for i, c in enumerate(FIELDS)])
    groups = let(fields, lambda held: F.transform(terms, lambda term, slot: hits(term, slot, held)))
    scored = let(groups, lambda g: F.when(F.forall(g, lambda h: F.size(h) > 0), _figures(g)))
    held = phrase_candidates(rarest, expansion, index).join(index.documents.select("id", "logcount", *FIELDS), "id")
    found = held.select("phrase", "whole", "id", "logcount", scored.alias("s")).where(F.col("s").isNotNull())
    flat = found.select("phrase", "whole", "id", "logcount", "s.*")
    order = W.partitionBy("phrase", "whole").orderBy(*_best_first())
    return flat.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n", "logcount")


def best_matches(requests: DataFrame, index: SearchIndex, limit: int, direct: int = DIRECT) -> DataFrame:
    """Rows of ``score_matches`` that include the first ``limit`` of every request.

    Documents with all words of a request come first, so those are looked up first, by
    the rarest word. Only requests with fewer than ``limit`` of them go on to the
    documents with fewer leading words. Equal phrases are looked up once, and at most
    2 x ``limit`` documents of each leave: of these, fewer than ``limit`` can hold a
    longer phrase of the same request. When all requests' words have at most ``direct``
    hits, counted beforehand, ``score_matches`` gives the same first ones.
    """
    terms = _query_words(requests).select("term", "is_last")
    expansion = checkpoint(expand_terms(terms.distinct(), index.spellings, index.prefixes))
    hits = terms.join(expansion.join(index.frequencies, "word"), ["term", "is_last"]).agg(F.sum("docs")).head()[0] or 0
    if hits <= direct:
        return score_matches(requests, index, expansion)
    asked = leading_phrases(requests)
    phrases = asked.select("phrase", "whole").distinct()
    rarest = checkpoint(rarest_terms(phrases, expansion, index.frequencies))

    def looked_up(rows: DataFrame) -> DataFrame:
        needed = rarest.join(rows.select("phrase", "whole").distinct(), ["phrase", "whole"], "left_semi")
        best = best_of_phrases(needed, expansion, index, 2 * limit)
        return rows.drop("matched").join(best, ["phrase", "whole"]).drop("phrase", "whole")

    complete = checkpoint(looked_up(asked.where("whole")))
    enough = complete.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    partial = looked_up(asked.where("NOT whole").join(enough, "request_id", "left_anti"))
    longest = W.partitionBy("request_id", "id").orderBy(F.desc("matched"))
    both = complete.unionByName(partial).withColumn("_n", F.row_number().over(longest)).where("_n = 1")
    return both.select("request_id", "id", "matched", "typos", "span", "field", "exact")


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= 20:
        raise ValueError("limit must be at least 1 and at most 20")


def rank_hits(scored: DataFrame, documents: DataFrame, limit: int = 10) -> DataFrame:
    """First ``limit`` documents per request, ranked from 1, with their fields."""
    _check_limit(limit)
    order = W.partitionBy("request_id").orderBy(F.desc("matched"), *_best_first())
    popular = documents.select("id", "logcount")
    top = scored.join(popular, "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return top.drop("logcount").join(documents, "id")


def map_hits(hits: DataFrame) -> DataFrame:
    """Replace the search id by (entity_type, rowid) and order the record's fields."""
    return hits.withColumn("_e", parse_search_id(F.col("id"))).select(
        "request_id", "rank", "_e.entity_type", "_e.rowid", *FIELDS, "lon", "lat", "logcount"
    )


def dedup_hits(hits: DataFrame) -> DataFrame:
    """Best-ranked hit per type and case-folded name (and artist, for tracks and albums)."""
    name = (
        F.when(F.col("entity_type") == "track", F.col("track_name_norm"))
        .when(F.col("entity_type") == "album", F.col("album_name_norm"))
        .when(F.col("entity_type") == "artist", F.col("artist_name"))
        .when(F.col("entity_type") == "label", F.col("label"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown entity type "), F.col("entity_type"))))
    )
    artist = F.when(F.col("entity_type").isin("track", "album"), F.col("artist_name"))
    keyed = hits.withColumns({"_name": fold_key(name), "_artist": fold_key(artist)})
    window = W.partitionBy("request_id", "entity_type", "_name", "_artist").orderBy("rank")
    return keyed.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", "_name", "_artist")


def search(requests: DataFrame, index: SearchIndex, limit: int = 10, direct: int = DIRECT) -> DataFrame:
    """Hit records per text request, best first; duplicates are removed after the limit is applied.

    ``direct`` is that of ``best_matches`` and changes no row.
    """
    _check_limit(limit)
    ranked = rank_hits(best_matches(requests, index, limit, direct), index.documents, limit)
    return dedup_hits(map_hits(ranked))
