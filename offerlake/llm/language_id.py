"""Language identification by cross-parsing entropy.

A text is parsed into the longest phrases that occur in the training text of a language,
the words that its labelled texts have most often, counted in all of them; the fewer phrases, the closer the language. The training text of each language is held
as a suffix automaton: following its transitions tells how far a match goes on, and a
missing transition ends the phrase. The phrase count is normalised to bits for each
symbol (phrases times the logarithm of the training length, over the text's length), and
the language with the fewest wins.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm.shared_windows import mix
from offerlake.llm.tables import checkpointed, in_small_batches, one_model, slices

#: Symbols of a part of a text; the parts of all texts advance together.
PART = 256
#: Bytes and rows of text that one step parses, and the bytes it may take for what the parts went through.
STEP_BYTES, STEP_ROWS, TRACE_BYTES = 1 << 19, 4000, 32 << 20
#: Letters from which on a text's cost is held against the calibrated bound.
JUDGED_LETTERS = 100
#: A word that is learned: letters and marks, 16 at most.
WORD = r"[\p{L}\p{M}]{1,16}"
#: The prediction for texts without a letter.
UNDECIDED = "und"


@dataclass(frozen=True)
class Sample:
    """Training text by language, in order of language."""

    texts: tuple[tuple[str, str], ...]


def _half(text_col: str) -> Column:
    """Which half of the texts one is in; equal texts are in the same."""
    return F.pmod(F.xxhash64(text_col), F.lit(2))


def _counted(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """How often each word is in the labelled texts: `lang`, `half` (of the texts), `word`, `n`."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0))).alias("word")
    return known.select(F.col(lang_col).alias("lang"), _half(text_col).alias("half"), words).groupBy("lang", "half", "word").agg(F.count(F.lit(1)).alias("n"))


def _sample(counted: DataFrame, chars: int) -> Sample:
    """Each language's most frequent words, until they and a separator each fill `chars` characters; ties in order of the word."""
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    first = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= chars // 2)
    until = F.sum(F.length("word") + 1).over(most.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = first.withColumn("until", until).where(F.col("until") <= chars + 1).select("lang", "nth", "word").collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.nth)):
        texts.setdefault(row.lang, []).append(row.word)
    return Sample(tuple((lang, " ".join(words)) for lang, words in texts.items()))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", chars_per_language: int = 80_000) -> Sample:
    """Learn from the words of all labelled texts.

    The words are counted in every labelled text, whole; an automaton holds the
    `chars_per_language` characters of those that its language has most often. This
    bounds the model, not what is read: it is a vocabulary, and what is collected grows
    with the number of languages only. A longer run of letters than `WORD` takes, as
    scripts without spaces have, is several words. Rows whose language or text is null
    teach nothing.
    """
    return _sample(_counted(docs, lang_col, text_col), chars_per_language)


def calibrate(docs: DataFrame, sample: Sample, lang_col: str = "lang", text_col: str = "text", slack: float = 1.25) -> float:
    """The bits for each symbol that texts of the learned languages stay below.

    `slack` times the highest cost of all labelled texts, whole, of a language that `sample`
    has, where a text has `JUDGED_LETTERS` symbols: short texts can cost anything. Without
    such a text nothing is too dear.
    """
    known = docs.where(F.col(lang_col).isin([lang for lang, _ in sample.texts]))
    highest = predict(known, sample, id_col=lang_col, text_col=text_col).where(F.col("n_symbols") >= JUDGED_LETTERS).agg(F.max("bits")).head()[0]
    return float("inf") if highest is None else slack * highest


def learn_and_calibrate(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", chars_per_language: int = 80_000, slack: float = 1.25
) -> tuple[Sample, float]:
    """What `learn` gives, and a bound by `calibrate` for which each half of the texts is held against what the other half teaches.

    So every labelled text teaches, and every one is held back once. Where the texts of
    either half teach nothing of the other's languages, nothing is too dear.
    """
    counted = checkpointed(_counted(docs, lang_col, text_col))
    bounds = []
    for half in (0, 1):
        others = _sample(counted.where(F.col("half") != half), chars_per_language)
        bounds.append(calibrate(docs.where(_half(text_col) == half), others, lang_col, text_col, slack))
    found = [bound for bound in bounds if bound < float("inf")]
    return _sample(counted, chars_per_language), max(found, default=float("inf"))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case code point, or 0 for what is no letter or mark."""
    table = np.zeros(sys.maxunicode + 1, np.int32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha() or (code > 767 and unicodedata.category(char)[0] == "M"):
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _plain(text: str) -> np.ndarray:
    """Lower-case letters, with one 0 for each run of other characters."""
    codes = _letters()[_code_points(text)]
    return codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])] if len(codes) else codes


def _edges(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's suffix automaton: its transitions as state * width + symbol and next state, and its states."""
    moves: dict[int, int] = {}
    outgoing: list[list[int]] = [[]]
    links, lengths, last = [-1], [0], 0
    for symbol in symbols:
        state = len(lengths)
        lengths.append(lengths[last] + 1)
        links.append(0)
        outgoing.append([])
        at = last
        while at >= 0 and at * width + symbol not in moves:
            moves[at * width + symbol] = state
            outgoing[at].append(symbol)
            at = links[at]
        if at >= 0:
            after = moves[at * width + symbol]
            if lengths[after] == lengths[at] + 1:
                links[state] = after
            else:
                clone = len(lengths)
                lengths.append(lengths[at] + 1)
                links.append(links[after])
                outgoing.append(outgoing[after].copy())
                for other in outgoing[after]:
                    moves[clone * width + other] = moves[after * width + other]
                links[after] = links[state] = clone
                while at >= 0 and moves.get(at * width + symbol) == after:
                    moves[at * width + symbol] = clone
                    at = links[at]
        last = state
    n = len(moves)
    return np.fromiter(moves.keys(), np.int64, n), np.fromiter(moves.values(), np.int64, n), len(lengths)


def _packed(keys: np.ndarray, moves: np.ndarray, width: int, states: int) -> tuple[np.ndarray, np.ndarray]:
    """The transitions as rows of states laid over each other: each state's base, and the table.

    A state's transition by a symbol is at base + symbol, and the entry there holds the state
    that it belongs to above 32 bits of next state, -1 if none. States with many transitions
    are placed first; each round proposes a base for all that are left of a degree, and those
    whose places are free and nobody else's are taken.
    """
    order = np.argsort(keys)
    owner, symbol, move = keys[order] // width, keys[order] % width, moves[order]
    degree = np.bincount(owner, minlength=states)
    first = np.cumsum(degree) - degree
    size = 1 << max(8, int(2 * len(keys)).bit_length())
    table, base = np.full(size + width, -1, np.int64), np.zeros(states, np.int32)
    for wanted in np.unique(degree[degree > 0])[::-1]:
        left, turn = np.flatnonzero(degree == wanted), 0
        edges = first[left][:, None] + np.arange(wanted)
        while len(left):
            turn += 1
            place = mix(left.astype(np.uint64) + np.uint64(turn << 40)) % np.uint64(size)
            at = place.astype(np.int64)[:, None] + symbol[edges]
            free = np.flatnonzero((table[at] < 0).all(axis=1))
            claim = np.repeat(left[free], wanted).reshape(len(free), wanted)
            table[at[free]] = claim  # the last to claim a place has it
            won = (table[at[free]] == claim).all(axis=1)
            table[at[free]] = -1
            taken = free[won]
            base[left[taken]] = place[taken]
            table[at[taken]] = left[taken][:, None] << 32 | move[edges[taken]]
            stay = np.ones(len(left), bool)
            stay[taken] = False
            left, edges = left[stay], edges[stay]
    return base, table


class _Automata:
    """The suffix automata of all languages in one packed table of transitions.

    A text of n symbols has at most 3n transitions, whatever the alphabet.
    """

    def __init__(self, sample: Sample):
        texts = [(lang, _plain(text)) for lang, text in sample.texts]
        texts = [(lang, codes) for lang, codes in texts if codes.any()]
        self.languages = [lang for lang, _ in texts]
        alphabet = np.unique(np.concatenate([codes for _, codes in texts])) if texts else np.zeros(1, np.int32)
        self.symbol_of = np.zeros(sys.maxunicode + 1, np.int32)
        self.symbol_of[:] = len(alphabet)  # letters of no language
        self.symbol_of[alphabet] = np.arange(len(alphabet))
        self.width = width = len(alphabet) + 1
        roots, states, parts = [], 0, []
        for _, codes in texts:
            keys, moves, count = _edges(self.symbol_of[codes].tolist(), width)
            parts.append((keys + states * width, moves + states))
            roots.append(states)
            states += count
        self.roots = np.array(roots, np.int32)
        keys, moves = (np.concatenate([part[i] for part in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        self.base, self.table = _packed(keys, moves, width, max(1, states))
        restarts = np.tile(self.roots[:, None], (1, width))
        for nth, ((own, move), root) in enumerate(zip(parts, roots, strict=True)):
            first = own < (root + 1) * width
            restarts[nth, own[first] - root * width] = move[first]
        self.restarts = restarts.ravel()
        self.bits = np.log2([max(2, len(codes)) for _, codes in texts])

    def step(self, state: np.ndarray, symbol: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each, and whether a phrase ended before the symbol; `restart` tells where it begins anew."""
        found = self.table[self.base[state] + symbol]
        ended = (found >> 32) != state
        return np.where(ended, self.restarts[restart], found.astype(np.int32)), ended

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language; `symbols` holds the texts end to end."""
        parts = -(-lengths // PART)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        owner = np.repeat(np.arange(len(lengths)), parts)
        begin = np.repeat(np.cumsum(lengths) - lengths, parts) + nth * PART
        size = np.minimum(PART, np.repeat(lengths, parts) - nth * PART)
        total = np.zeros((len(lengths), len(self.roots)), np.int64)
        if not len(owner):
            return total
        group = max(1, TRACE_BYTES // (6 * int(size.max()) * len(owner)))
        for first in range(0, len(self.roots), group):
            chosen = np.arange(first, min(first + group, len(self.roots)))
            count = self._parse(symbols, begin, size, nth > 0, chosen)
            for at, language in enumerate(chosen):
                total[:, language] = np.bincount(owner, count[:, at], len(lengths))
        total[lengths > 0] += 1  # the last phrase, which nothing ended
        return total

    def _parse(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, follows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Phrases that end in each part, for each chosen language.

        All parts are parsed from the root first. Then each part that follows another one is
        parsed again from the state its predecessor ended in, until it is in the same state
        as before at the same place: from there on both parses are one. This repeats while a
        part's last state changes, so that the phrases are those of the whole text.
        """
        n, m, longest = len(begin), len(chosen), int(size.max())
        order = np.argsort(-size, kind="stable")  # parts that end early leave together
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        begin, size = begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        lanes = (chosen * self.width).astype(np.int32)
        symbol = np.zeros((longest, n), np.int32)
        states, counts = np.zeros((longest, n * m), np.int32), np.zeros((longest, n * m), np.int16)
        state, count = np.tile(self.roots[chosen], (n, 1)), np.zeros((n, m), np.int16)
        for step, k in enumerate(live.tolist()):
            symbol[step, :k] = symbols[begin[:k] + step]
            now = symbol[step, :k, None]
            move, ended = self.step(state[:k], now, now + lanes)
            count[:k] += ended
            state[:k] = move
            states[step, : k * m], counts[step, : k * m] = move.ravel(), count[:k].ravel()
        last, every = np.repeat(size - 1, m), np.arange(n * m)
        before_of, after_of = np.full(n * m, -1), np.full(n * m, -1)
        second = np.flatnonzero(follows)
        own, before = ((rank[part][:, None] * m + np.arange(m)).ravel() for part in (second, second - 1))
        before_of[own], after_of[before] = before, own
        # since `met` a part's counts are greater by `more` than those written
        met, more = np.full(n * m, longest), np.zeros(n * m, np.int16)
        redo = own
        while len(redo):
            again = redo[more[redo] != 0]
            counts[:, again] += np.where(np.arange(longest)[:, None] >= met[again], more[again], 0).astype(np.int16)
            met[again], more[again] = longest, 0
            ends = states[last[redo], redo]
            column, now = redo, states[last[before_of[redo]], before_of[redo]]
            fresh, part, lane = np.zeros(len(redo), np.int16), redo // m, lanes[redo % m]
            for step in range(longest):
                if not len(column):
                    break
                stay = size[part] > step
                if not stay.all():
                    column, now, fresh, part, lane = column[stay], now[stay], fresh[stay], part[stay], lane[stay]
                at = symbol[step, part]
                now, ended = self.step(now, at, at + lane)
                fresh += ended
                same = now == states[step, column]
                if same.any():
                    both = column[same]
                    met[both], more[both] = step, fresh[same] - counts[step, both]
                    stay = ~same
                    column, now, fresh, part, lane = column[stay], now[stay], fresh[stay], part[stay], lane[stay]
                states[step, column], counts[step, column] = now, fresh
            redo = after_of[redo[states[last[redo], redo] != ends]]
            redo = redo[redo >= 0]
        total = counts[last, every] + np.where(last >= met, more, 0)
        return total.reshape(n, m)[rank]


def _predict(batches: Iterator[pa.RecordBatch], sample: Sample, with_text: bool = False) -> Iterator[pa.RecordBatch]:
    """Predict from the first column, `_text`; it stays with `with_text`."""
    model = one_model(("language ID", sample), lambda: _Automata(sample))
    pieces = (part.slice(i, STEP_ROWS) for whole in batches for part in slices(whole, "_text", STEP_BYTES) for i in range(0, len(part), STEP_ROWS))
    for batch in pieces:
        held = pc.fill_null(batch.column("_text"), "").to_pylist()
        plain = [_plain(text) for text in held]
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        lettered = np.array([bool(codes.any()) for codes in plain])
        if model.languages:
            symbols = model.symbol_of[np.concatenate(plain)]
            cost = model.phrases(symbols, lengths) * model.bits / np.maximum(1, lengths)[:, None]
            order = np.argsort(cost, axis=1, kind="stable")
            first = cost[np.arange(len(held)), order[:, 0]]
            second = cost[np.arange(len(held)), order[:, min(1, len(model.languages) - 1)]]
            margin = 1 - first / np.maximum(second, 1e-12) if len(model.languages) > 1 else np.ones(len(held))
            best = [model.languages[i] if ok else UNDECIDED for i, ok in zip(order[:, 0], lettered, strict=True)]
            score = np.where(lettered, np.clip(margin, 0, 1), 0.0).tolist()
            bits = [float(b) if ok else None for b, ok in zip(first, lettered, strict=True)]
        else:
            best, score, bits = [UNDECIDED] * len(held), [0.0] * len(held), [None] * len(held)
        kept = range(0 if with_text else 1, batch.num_columns)
        made = {
            "lang_pred": pa.array(best, pa.string()),
            "score": pa.array(score, pa.float64()),
            "bits": pa.array(bits, pa.float64()),
            "n_symbols": pa.array(lengths),
        }
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), *made.values()], names=[*(batch.schema.names[i] for i in kept), *made]
        )


def predict(
    docs: DataFrame, sample: Sample, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Predict the language of each whole text: `id_col`, `lang_pred`, `score`, `bits`, `n_symbols`.

    The columns named in `keep` stand between the id and the prediction.

    `score` is how much fewer bits the best language needs than the second (0 to 1; 1 if
    only one was learned); ties go to the language that sorts first; `bits` is the best
    language's cost for each of the `n_symbols` that are parsed: letters, and one for each
    run of other characters. A text that is null, empty or without a letter gives `und`,
    score 0 and null bits, as does every text where nothing was learned. One row per input
    row; only the text decides; other columns are ignored, whatever their names.
    """
    passed = (id_col, *(c for c in keep if c != text_col))
    inner = [f"_{i}" for i in range(len(passed))]
    with_text = text_col in keep
    rows = docs.select(F.col(text_col).alias("_text"), *(F.col(c).alias(i) for c, i in zip(passed, inner, strict=True)))
    kinds = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(passed, inner, strict=True))
    schema = "_text string, " * with_text + f"{kinds}, lang_pred string, score double, bits double, n_symbols long"
    found = in_small_batches(rows).mapInArrow(lambda batches: _predict(batches, sample, with_text), schema)
    outer = {c: F.col(i).alias(c) for c, i in zip(passed, inner, strict=True)} | {text_col: F.col("_text").alias(text_col)}
    return found.select(outer[id_col], *(outer[c] for c in keep), "lang_pred", "score", "bits", "n_symbols")
