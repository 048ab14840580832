"""Full-text search over postings: required, optional and excluded terms, BM25 ranks and snippets.

A term is a word, a phrase of words, or either with a trailing * (its last word is a prefix). Words are
folded: lower case, diacritics stripped, split at what is no letter or digit.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Latin letters with marks and the letters below them; folding other scripts is by lower case alone.
_MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and not unicodedata.combining(unicodedata.normalize("NFD", c)[0]))
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def tokens(text: Column) -> Column:
    """Folded words of a text, in order."""
    plain = F.lower(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{M}+", ""), _MARKED, _PLAIN))
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass(frozen=True)
class Terms:
    """What a hit holds: all of `all_of`, one of `any_of` if there are any, none of `none_of`, and each pair of
    `near` at most so many words apart: (term, term, words between)."""

    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    near: tuple[tuple[str, str, int], ...] = ()

    def ranked(self) -> list[str]:
        """The terms that count for the rank."""
        return list(dict.fromkeys([*self.all_of, *self.any_of, *(t for pair in self.near for t in pair[:2])]))


def words_of(term: str) -> tuple[list[str], bool]:
    """The folded words of a term, and whether the last is a prefix."""
    return re.findall(r"\w+", fold(term.strip('*"')).replace("_", " ")), term.endswith("*")


def _term_places(each: DataFrame, terms: list[str]) -> DataFrame:
    """(id, conversation_id, sequence, dl, term, tf, places): the starts of each term (by its number) in each message that holds it.

    `each` has a row for each word of a message: id, conversation_id, sequence, dl, place, word.
    """
    parts = []
    for n, term in enumerate(terms):
        words, prefix = words_of(term)
        for k, w in enumerate(words):
            fits = F.col("word").startswith(w) if prefix and k == len(words) - 1 else F.col("word") == w
            parts.append(F.when(fits, F.struct(F.lit(n).alias("term"), F.lit(k).alias("k"), F.lit(len(words)).alias("of"))))
    found = each.withColumn("part", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())))
    found = found.select("id", "conversation_id", "sequence", "dl", "part.term", "part.of", (F.col("place") - F.col("part.k")).alias("start"))
    key = ["id", "conversation_id", "sequence", "dl", "term"]
    starts = found.groupBy(*key, "of", "start").agg(F.count("*").alias("n")).where("n = of")
    return starts.groupBy(*key).agg(F.count("*").alias("tf"), F.collect_list("start").alias("places"))


def search(messages: DataFrame, conversations: DataFrame, terms: Terms, adapter: str | None = None, since: str | None = None, limit: int | None = 20) -> DataFrame:
    """(message_id, conversation_id, sequence, rank): hits by BM25, smaller first, over the whole corpus' statistics.

    Words are exploded once and those of a term kept, so what is shuffled are the places of the terms. Without
    a ranked term nothing is found. A message whose text is null or empty holds nothing.
    """
    rows = messages.select("id", "conversation_id", "sequence", tokens(F.col("content")).alias("w"))
    n, mean = rows.agg(F.count("*"), F.avg(F.size("w"))).first() if _terms(terms)[0] else (0, None)
    each = rows.select("id", "conversation_id", "sequence", F.size("w").alias("dl"), F.posexplode("w").alias("place", "word"))
    return _hits(each, n, mean, conversations, terms, adapter, since, limit)


def search_postings(index: DataFrame, n: int, mean: float | None, conversations: DataFrame, terms: Terms, adapter: str | None = None, since: str | None = None, limit: int | None = 20) -> DataFrame:
    """What `search` gives, from `placed_postings` of `n` messages of `mean` words.

    Only postings of the terms' words are read: whole words lie in the parts of their hashes, and within a part
    words are sorted, so that a prefix reads its range of each part.
    """
    whole, prefixes = set(), set()
    for words, prefix in map(words_of, [*terms.ranked(), *terms.none_of]):
        whole |= set(words[:-1] if prefix else words)
        prefixes |= set(words[-1:] if prefix else ())
    wanted = F.col("word").isin(sorted(whole))
    for p in sorted(prefixes):
        wanted = wanted | F.col("word").startswith(p)
    kept = index.where(wanted)
    if not prefixes:
        kept = kept.where(F.col("part").isin([part_of(F.lit(w)) for w in sorted(whole)]) if whole else F.lit(False))
    each = kept.select("id", "conversation_id", "sequence", "dl", F.explode("places").alias("place"), "word")
    return _hits(each, n, mean, conversations, terms, adapter, since, limit)


#: Parts of an index, by the word's hash.
PARTS = 16


def part_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PARTS)).cast("int")


def placed_words(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, sequence, dl, word, places): where each word of a message stands, in order; one without words has none.

    Messages that agree in all keys count as one. What is shuffled and sorted are messages, not their words, which are
    counted where they lie: each task holds a message's words at a time.
    """
    rows = messages.select("conversation_id", "id", "sequence", tokens(F.col("content")).alias("w")).where(F.size("w") > 0)
    placed = F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("place")))
    same = rows.groupBy("conversation_id", "id", "sequence", F.size("w").alias("dl")).agg(F.collect_list(placed).alias("s"))
    held = same.withColumn("s", F.sort_array(F.flatten("s")))
    word = lambda i: F.get("s", i)["word"]
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (word(i) != word(i - 1)))
    runs = held.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("s"))))
    own = F.zip_with("starts", "ends", lambda i, j: F.struct(word(i).alias("word"), F.slice("s", i + 1, j - i)["place"].alias("places")))
    each = runs.select("conversation_id", "id", "sequence", "dl", F.explode(own).alias("x"))
    return each.select("conversation_id", "id", "sequence", "dl", "x.word", "x.places")


def placed_postings(messages: DataFrame) -> DataFrame:
    """(word, conversation_id, id, sequence, dl, places, part): the words of each message, with their parts of the index."""
    each = placed_words(messages).select("word", "conversation_id", "id", "sequence", "dl", "places")
    return each.withColumn("part", part_of(F.col("word")))


def _terms(terms: Terms) -> tuple[list[str], list[str]]:
    """The terms with words that count for the rank, and all of them."""
    ranked = [t for t in terms.ranked() if words_of(t)[0]]
    return ranked, [*ranked, *(t for t in dict.fromkeys(terms.none_of) if words_of(t)[0] and t not in ranked)]


def _hits(each: DataFrame, n: int, mean: float | None, conversations: DataFrame, terms: Terms, adapter: str | None, since: str | None, limit: int | None) -> DataFrame:
    """Ranked messages from the words in `each`, of a corpus of `n` messages with `mean` words."""
    ranked, every = _terms(terms)
    if not ranked:
        return each.limit(0).select(F.col("id").alias("message_id"), "conversation_id", "sequence", F.lit(0.0).alias("rank"))
    found = _term_places(each, every)
    counts = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = F.when(idf > 0, idf).otherwise(LEAST_IDF) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean or 1.0))))
    scored = found.join(F.broadcast(counts), "term").withColumn("part", F.when(F.col("term") < len(ranked), part).otherwise(0.0))
    held = F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("held")
    hits = scored.groupBy("id", "conversation_id", "sequence").agg((-F.sum("part")).alias("rank"), held)
    has = lambda t: F.map_contains_key("held", F.lit(every.index(t)))
    keep = F.lit(True)
    for t in terms.all_of:
        keep = keep & (has(t) if t in every else F.lit(True))
    if optional := [has(t) for t in terms.any_of if t in every]:
        keep = keep & reduce(Column.__or__, optional)
    for t in terms.none_of:
        keep = keep & (~has(t) if t in every else F.lit(True))
    for one, other, gap in terms.near:
        ends = [F.element_at("held", F.lit(every.index(t))) for t in (one, other)]
        width = [len(words_of(t)[0]) for t in (one, other)]
        apart = lambda i, j: F.when(i < j, j - i - width[0]).otherwise(i - j - width[1])  # noqa: B023, E731
        keep = keep & has(one) & has(other) & F.exists(ends[0], lambda i: F.exists(ends[1], lambda j: apart(i, j) <= gap))  # noqa: B023
    kept = conversations.where(F.col("adapter_id") == adapter) if adapter else conversations
    kept = kept.where(S.activity() >= since) if since else kept
    hits = hits.where(keep).join(kept.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    hits = hits.select(F.col("id").alias("message_id"), "conversation_id", "sequence", "rank").orderBy("rank", "sequence", "message_id")
    return hits.limit(limit) if limit else hits


def with_snippets(hits: DataFrame, messages: DataFrame, terms: Terms, size: int = 20) -> DataFrame:
    """`hits` with a snippet: `size` words around the first hit, hits between >>> and <<<, ... where text is cut."""
    leaves = [x for x in map(words_of, terms.ranked()) if x[0]]

    @F.pandas_udf("string")
    def snippet(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            found = [(m.start(), m.end(), fold(m[0])) for m in re.finditer(r"[^\W_]+", text or "")]
            marked = set()
            for words, prefix in leaves:
                for i in range(len(found) - len(words) + 1):
                    own = [w for _, _, w in found[i : i + len(words)]]
                    if own[:-1] == words[:-1] and (own[-1].startswith(words[-1]) if prefix else own[-1] == words[-1]):
                        marked |= set(range(i, i + len(words)))
            if not found:
                return ""
            lo = max(0, min(marked, default=0) - size // 4)
            hi = min(len(found), lo + size)
            out = "..." if lo else ""
            at = found[lo][0] if lo else 0
            for k in range(lo, hi):
                a, b, _ = found[k]
                out += text[at:a] + (">>>" if k in marked and k - 1 not in marked else "") + text[a:b] + ("<<<" if k in marked and k + 1 not in marked else "")
                at = b
            return out + ("..." if hi < len(found) else text[at:])

        return texts.map(one)

    texts = messages.select(F.col("id").alias("message_id"), "content")
    return hits.join(texts, "message_id").withColumn("snippet", snippet("content")).drop("content").orderBy("rank", "sequence", "message_id")
