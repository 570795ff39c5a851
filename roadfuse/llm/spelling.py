"""Spelling variants: words one edit apart, found by moving states through a distributed trie level by level.

The trie is a table of edges (node, label, what lies beneath), one level at a time; a node is the
prefix itself. A state is (word, position, node, edits). A word's own path is in the trie, so
states without an edit need no join until they branch. An edit in a word's first half leaves its
second half whole and the other way round: each word runs forwards and reversed, and branches in
the later half only, where nodes have few children. An edge tells which two letters may follow and
how many letters are left beneath it, so nearly all states that would die are dropped inside
the join that makes them.

Substitutions by a later letter and deletions are enough: the other ones are the same pairs seen
from the other word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.shared import written

#: Letters below which a level has one letter; the levels of longer words double in size.
SINGLE = 32
#: Distinct words a counting task holds before it gives out its counts.
HELD = 200_000
#: A-Z, a-z and U+00C0 to U+00FF in UTF-8, in lower case.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_OUTSIDE = re.compile(rb"[^a-z\x80-\xc3]")
_PIECE = 1 << 20
_FORWARDS, _BACKWARDS = "<", ">"


def _pieces(text: bytes) -> Iterator[bytes]:
    """Stretches of about 1 MB that cut no run."""
    start = 0
    while start < len(text):
        end = start + _PIECE
        cut = _OUTSIDE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def word_counts(docs: DataFrame, least_letters: int = 7, least_count: int = 2, slip_every: int | None = None) -> DataFrame:
    """(word, n long) of all whole texts: runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.

    With ``slip_every``, runs whose crc32 of ``<doc_id>:<run>`` it divides lose the letter at that crc32 modulo their
    length, as a slip of the pen does; a null doc_id counts as an empty one. Words of fewer letters or occurrences are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.binary()).cast(pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"]
            )
            totals.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).cast(pa.large_binary())):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in _pieces((text.as_py() or b"").lower()):
                    for word in _RUN.findall(piece):
                        if len(word) < least_letters:
                            continue
                        if slip_every and (h := zlib.crc32(word, start)) % slip_every == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            word = (letters[:at] + letters[at + 1 :]).encode()
                        totals[word] = totals.get(word, 0) + 1
                if len(totals) >= HELD:
                    yield given()
        if totals:
            yield given()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))


def _levels(least: int, longest: int) -> list[tuple[int, int]]:
    """(depth, letters of its edges) of all levels of words of ``least`` to ``longest`` letters; the side's mark is the first letter."""
    out, depth, size = [], 1 + least // 2, 1
    while depth <= longest:
        out.append((depth, size))
        depth, size = depth + size, 1 if depth + size < SINGLE else size * 2
    return out


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _letter(w: Column, at: Column) -> Column:
    return F.pmod(F.ascii(F.substring(w, at, F.lit(1))), F.lit(63))


def _edges(rows: DataFrame, depth: int, size: int) -> DataFrame:
    """(node, label, rests, first, second): what is left beneath an edge, in letters, and its next two letters, as bits."""
    w, length = F.col("w"), F.col("length")
    end = F.least(F.lit(depth + size), length)
    rest = length - end
    nothing = F.lit(0).cast("long")
    return (
        rows.select(
            F.substring(w, 1, depth).alias("node"),
            F.substring(w, depth + 1, size).alias("label"),
            _bit(F.least(rest, F.lit(62))).alias("rests"),
            F.when(rest >= 1, _bit(_letter(w, end + 1))).otherwise(nothing).alias("first"),
            F.when(rest >= 2, _bit(_letter(w, end + 2))).otherwise(nothing).alias("second"),
        )
        .groupBy("node", "label")
        .agg(*[F.bit_or(c).alias(c) for c in ("rests", "first", "second")])
    )


def _moved(states: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """States (w, length, at, node, edits) one level on; all come out with one edit. ``at`` counts letters of w that are done."""
    w, length, at, label = F.col("w"), F.col("length"), F.col("at"), F.col("label")
    n = F.lit(1) if size == 1 else F.char_length(label)
    own = F.substring(w, at + 1, n)
    here = F.substring(w, at + 1, F.lit(size))

    def lives(end: Column) -> Column:
        rest = length - end
        follows = lambda bits, k: (rest < k) | (F.col(bits).bitwiseAND(_bit(_letter(w, end + k))) != 0)
        return (F.col("rests").bitwiseAND(_bit(F.least(rest, F.lit(62)))) != 0) & follows("first", 1) & follows("second", 2)

    fresh = F.col("edits") == 0
    if size == 1:
        swap = fresh & (label > own)
        drop = fresh & (at + 2 <= length) & ((label != own) & (label == F.substring(w, at + 2, F.lit(1))) | (label == own) & (at + 2 == length))
    else:
        swap = fresh & (at + n <= length) & (label > own) & (F.levenshtein(label, own) == 1)
        drop = fresh & (at + n + 1 <= length) & ((label != own) | (at + n + 1 == length)) & (F.levenshtein(label, F.substring(w, at + 1, n + 1)) == 1)
    same = (F.col("edits") == 1) & (label == here)
    ends = [(same | swap, at + n), (drop, at + n + 1)]
    ends = F.array_compact(F.array(*[F.when(how & lives(end), end) for how, end in ends]))
    joined = states.join(edges, "node").select("w", "length", F.concat("node", "label").alias("node"), F.explode(ends).alias("at"))
    return joined.select("w", "length", "at", "node", F.lit(1).alias("edits"))


def neighbours(words: DataFrame, least_letters: int = 7) -> DataFrame:
    """(word, near): both orders of all pairs of ``words`` (word, distinct, of ``least_letters`` or more) that one inserted, deleted or replaced letter makes equal."""
    spark = words.sparkSession
    letters = F.char_length("word")
    sides = words.select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit(_FORWARDS), "word").alias("w"), (letters + 1).alias("length"), (F.floor(letters / 2) + 1).cast("int").alias("branch")),
                F.struct(
                    F.concat(F.lit(_BACKWARDS), F.reverse("word")).alias("w"), (letters + 1).alias("length"), (F.ceil(letters / 2) + 1).cast("int").alias("branch")
                ),
            )
        )
    )
    sides = written(sides, "spelling-sides")
    longest = sides.agg(F.max("length")).first()[0] or 0
    alive, steps = None, []
    for depth, size in _levels(least_letters, longest):
        # A word takes part from the level of its first branch; shorter partners do so no later.
        rows = sides.filter((F.col("branch") < depth + size) & (F.col("length") > depth))
        states = rows.select("w", "length", F.lit(depth).alias("at"), F.substring("w", 1, depth).alias("node"), F.lit(0).alias("edits"))
        if alive is not None:
            states = states.unionByName(alive)
        step = written(_moved(states, _edges(rows, depth, size), size), "spelling-states")
        alive = step.filter("at < length")
        steps.append(step.filter("at = length").select("w", "node"))
    if not steps:
        return spark.createDataFrame([], "word string, near string")
    ended = steps[0]
    for step in steps[1:]:
        ended = ended.union(step)
    plain = lambda c: F.when(F.col(c).startswith(_FORWARDS), F.expr(f"substring({c}, 2)")).otherwise(F.reverse(F.expr(f"substring({c}, 2)")))
    pairs = ended.select(plain("w").alias("word"), plain("node").alias("near"))
    return pairs.select(F.inline(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))).distinct()


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the end by pointer doubling; each step raises n by ``ratio``, which bounds the rounds."""
    to = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2.0, 63 / math.log2(ratio))))):
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(to.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        to = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return to


def variants(words: DataFrame, least_letters: int = 7, ratio: int = 10) -> DataFrame:
    """Per row of ``words`` (word, n): word, n, form, root, n_near, form_n.

    ``n_near`` counts the words one edit away. ``form`` is the one of them with largest n (ties: smallest in code-point order), if that is
    ``ratio`` (2 or more) times the word's n at least; ``root`` is the last of form's form's form, the word itself without a form.
    """
    words = words.select("word", "n")
    near = written(neighbours(words.select("word"), least_letters), "spelling-neighbours")
    best = (
        near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    )
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.least")).alias("near_n")
    )
    good = F.col("near_n") >= ratio * F.col("n")
    judged = written(
        judged.select("word", "n", "n_near", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "spelling-forms"
    )
    root = _roots(judged.filter("form is not null").select("word", "form"), ratio)
    return judged.join(root, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_letters: int = 7, least_count: int = 2, ratio: int = 10, slip_every: int | None = None) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with their neighbours and forms, as in ``variants``.

    Null and empty texts have no words, repeated rows count each, and other columns are ignored. A table without words gives no rows.
    """
    words = written(word_counts(docs, least_letters, least_count, slip_every), "spelling-words")
    return variants(words, least_letters, ratio)
