"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Words are runs of letters, lower-cased A-Z, of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences or more.

A dictionary holds all grams of ``SHORTEST`` letters, and a longer gram, up to ``LONGEST``, if the gram without its last letter
occurs in the words more often than ``SHARE`` of all places: grams grow while they are frequent. So at most
(LONGEST - SHORTEST) / SHARE grams are frequent, whatever the number of words, and those alone go to the tasks. A word is cut
into the longest gram at each place, without those that end no later than one before them.

An edit before letter i, or of it, can change a gram only if i lies between the end of the gram less ``LONGEST`` and its last
letter (the letter after it, where the gram could grow): a longer gram that starts at the edit or before it can't swallow a gram
that ends later. So for a place m in the word, an edit at m or after leaves the grams at its left as they are, and an edit before
m those at its right. A word probes the merged list of all grams at the left of m, and of all at its right: the words of the same
length, one more or one less, that begin or end with that run of grams. m is chosen so that the shorter of both runs is longest.
What the probes meet is verified by the edit distance.

Some words, most of them short, have no such m. Two of them are compared if one half agrees: of two words one edit apart, the
half that the edit doesn't touch is equal. Letters whose counts differ in parity rule most pairs out before the edit distance is computed.

Defined results: a null text has no words; a null id counts as the empty text; very long texts and words are read whole, in time in
proportion to their length; of equally frequent forms the smallest word by code points is taken; repeated rows count as often as
they occur; an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import LOWER, UPPER, keyed, pieces, pin

RUN_PATTERN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a letter.
SLIP = 97
SHORTEST, LONGEST = 2, 4
#: Share of all places above which a gram is frequent.
SHARE = 1 / 2000
_ROWS = "key long, probe boolean, weak boolean, parity long, word string, n long"


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, n). A run whose crc32 with the id is a multiple of ``slip`` loses one letter first."""
    runs = keyed(docs, key, text).select(
        F.coalesce(F.col("_c0").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("_c1", UPPER, LOWER), F.lit(RUN_PATTERN), F.lit(0))).alias("run"))
    drawn = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(slip)) == 0, less).otherwise(F.col("run"))
    words = drawn.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 4096):
            seen: Counter[str] = Counter()
            for word in piece.column(0).to_pylist():
                for n in range(SHORTEST, LONGEST):
                    seen.update(word[i : i + n] for i in range(len(word) - n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])


def frequent_grams(words: DataFrame, share: float = SHARE) -> frozenset[str]:
    """Grams shorter than ``LONGEST`` that occur at more than ``share`` of all places: (LONGEST - SHORTEST) / share at most."""
    counts = pin(words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    places = counts.filter(F.char_length("gram") == SHORTEST).agg(F.sum("n")).first()[0] or 0
    return frozenset(r.gram for r in counts.filter(F.col("n") > places * share).collect())


def decompose(word: str, frequent: frozenset[str]) -> list[tuple[int, int, int, int]]:
    """Variable grams of a word: start, end, and the first and last place where an edit may change the gram."""
    out, reach = [], 0
    for start in range(len(word) - SHORTEST + 1):
        end = start + SHORTEST
        while end < len(word) and end - start < LONGEST and word[start:end] in frequent:
            end += 1
        if end > reach:
            reach = end
            grows = end - start < LONGEST and word[start:end] in frequent
            out.append((start, end, max(0, end - LONGEST), end - 1 + grows))
    return out


def split(word: str, grams: list[tuple[int, int, int, int]]) -> tuple[int, int] | None:
    """How many grams at the left and at the right stay, whichever side of the split an edit is on; none if there is no split."""
    best, found, right = 0, None, 0
    for left, (_, end, _, last) in enumerate(grams, 1):
        while right < len(grams) and grams[right][2] <= last:
            right += 1
        if right == len(grams):
            break
        covered = min(end, len(word) - grams[right][0])
        if covered > best:
            best, found = covered, (left, len(grams) - right)
    return found


def _key(side: str, length: int, run: int) -> int:
    return xxhash.xxh64_intdigest(f"{side}{length}", run) - (1 << 63)


def _runs(word: str, grams: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int]]:
    """Hashes of the first 1, 2, ... grams with their places, and of the last 1, 2, ..., with places counted from the end."""
    first, last, h = [], [], 0
    for start, end, _, _ in grams:
        first.append(h := xxhash.xxh64_intdigest(f"{start} {word[start:end]}", h))
    h = 1
    for start, end, _, _ in reversed(grams):
        last.append(h := xxhash.xxh64_intdigest(f"{len(word) - start} {word[start:end]}", h))
    return first, last


def keys(word: str, frequent: frozenset[str]) -> tuple[bool, list[int], list[int]]:
    """Whether the word has no split, keys under which it is stored, and keys that it probes."""
    grams, size = decompose(word, frequent), len(word)
    parts = split(word, grams)
    first, last = _runs(word, grams)
    stored = [_key("left", size, h) for h in first] + [_key("right", size, h) for h in last]
    if parts:
        left, right = first[parts[0] - 1], last[parts[1] - 1]
        # A shorter word with a split finds this one itself; those without are stored a second time for longer words.
        sides = [("left", size, left), ("left", size + 1, left), ("weak left", size - 1, left)]
        return False, stored, [_key(s, n, h) for s, n, h in [*sides, *[(s.replace("left", "right"), n, right) for s, n, _ in sides]]]
    stored += [_key("weak left", size, h) for h in first] + [_key("weak right", size, h) for h in last]
    probes = []
    for shorter in (size, size - 1):
        half = shorter // 2
        pair = [_key(f"half {side} {size}", shorter, xxhash.xxh64_intdigest(part)) for side, part in (("a", word[:half]), ("b", word[half + size - shorter :]))]
        stored += pair
    half = size // 2
    for longer in (size, size + 1):
        probes += [_key(f"half {side} {longer}", size, xxhash.xxh64_intdigest(part)) for side, part in (("a", word[:half]), ("b", word[half:]))]
    return True, stored, probes


def _index(frequent: frozenset[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1024):
                key, probe, weak, parity, words, ns = [], [], [], [], [], []
                for word, n in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    odd = 0
                    for c in word:
                        odd ^= 1 << ord(c) % 63
                    no_split, stored, probes = keys(word, frequent)
                    count = len(stored) + len(probes)
                    key += stored + probes
                    probe += [False] * len(stored) + [True] * len(probes)
                    weak += [no_split] * count
                    parity += [odd] * count
                    words += [word] * count
                    ns += [n] * count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(probe, pa.bool_()), pa.array(weak, pa.bool_()), pa.array(parity, pa.int64()), pa.array(words, pa.string()), pa.array(ns, pa.int64())],
                    names=["key", "probe", "weak", "parity", "word", "n"])

    return rows


def near_words(words: DataFrame, share: float = SHARE) -> DataFrame:
    """Each pair of words one edit apart once: a, a_n, b, b_n with a < b. ``words`` has word (distinct) and n."""
    rows = pin(words.select("word", "n").mapInArrow(_index(frequent_grams(words, share)), _ROWS), "gram_index")
    a, b = rows.filter("probe").alias("a"), rows.filter("not probe").alias("b")
    # Two words of one length that both have a split find each other twice: the smaller one's probe is enough.
    once = F.col("b.weak") | (F.char_length("a.word") != F.char_length("b.word")) | (F.col("a.word") < F.col("b.word"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.bit_count(F.col("a.parity").bitwiseXOR(F.col("b.parity"))) <= 2) & once
                 & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    lower = F.col("a.word") < F.col("b.word")
    low, high = F.struct("a.word", "a.n"), F.struct("b.word", "b.n")
    ends = met.select(F.when(lower, low).otherwise(high).alias("lo"), F.when(lower, high).otherwise(low).alias("hi"))
    return ends.select(F.col("lo.word").alias("a"), F.col("lo.n").alias("a_n"), F.col("hi.word").alias("b"), F.col("hi.n").alias("b_n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each round doubles the length of the path that was followed."""
    now = pin(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        a, b = now.alias("a"), now.alias("b")
        joined = a.join(b, F.col("a.root") == F.col("b.word"), "left")
        now = pin(joined.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP, share: float = SHARE) -> DataFrame:
    """word, n, n_near, form (the most frequent near word, if twice as frequent), form_n and root (the last of the forms)."""
    words = pin(count_words(docs, key, text, slip), "words")
    pairs = near_words(words, share)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    twice = F.col("near_n") >= 2 * F.col("n")
    known = pin(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(twice, F.col("near")).alias("form"), F.when(twice, F.col("near_n")).alias("form_n")), "variants")
    return known.join(_roots(known.filter("form is not null")), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
