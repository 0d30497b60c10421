"""Problem 4: the languages of each text and of its stretches, by prediction by partial matching.

For each language a context tree over bytes is trained: how often each byte followed each context of up
to ``ORDER`` bytes. Under the frozen counts a byte costs -log2 of its probability in the longest known
context; where the context has not seen it, an escape is paid and the next shorter one asked (method C:
a context with n symbols, d of them distinct, gives a symbol seen c times c / (n + d), the escape
d / (n + d)). A text's code length under a language is exact and needs no smoothing constant.

Contexts reach back to the beginning of a word, so a word has one code length per language, wherever it
stands: each task computes it once per distinct word, for all languages at once, by array lookups.
Words that every language finds improbable (names, technical terms) weigh little, quoted words nothing.
A language belongs to a text if it is the cheapest for a sentence, or for six words in a row, by a margin.
Stretches are the cheapest path through the words: half of the same margins is what a change of language
costs, at the end of a sentence or inside one, so that a stretch pays the whole margin to be entered and left.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions.itemsets import items

ORDER = 5
#: Labelled rows per language that the model is trained on besides the samples, drawn by hash.
TRAINING_ROWS = 400
#: Bits by which a sentence, or six words in a row, must be cheaper than under the text's other languages.
SENTENCE_MARGIN, RUN_MARGIN = 12.0, 30.0
RUN_WORDS = 6
#: The same for Chinese, in characters.
HAN_RUN_WORDS = 12
#: A word above this many bits a byte under every language counts as a name, with this weight.
NAME_BITS, NAME_WEIGHT = 2.6, 0.1
#: The words a sentence needs; a Chinese character counts as a word.
SENTENCE_WORDS = 3
HAN_WORDS = 5
REMEMBERED_WORDS = 300_000

_TOKEN = re.compile("[一-鿿]|[^\\W\\d_一-鿿]+|[.!?。！？…;\n()/—]")
_QUOTED = re.compile('“[^“”\n]{0,80}”|„[^„“”\n]{0,80}[“”]|«[^«»\n]{0,80}»|"[^"\n:]{0,80}"(?![:\\w])|「[^「」\n]{0,40}」|\'[^\'\n]{0,80}\'(?!\\w)')
_QUOTES = frozenset('“„«"「')
_BREAKS = frozenset(".!?。！？…;\n()/—")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, each followed by a space and preceded by one as first context; the word of each byte; its place."""
    encoded = [w.encode("utf-8", "surrogatepass") + b" " for w in words]
    lengths = np.array([len(e) for e in encoded])
    flat = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat, owner, place


def _contexts(flat: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each order d = 0..ORDER the packed context (d bytes before each byte; a space stands before a
    word), tagged with its length; beyond the word's beginning the context is the shorter one."""
    out = [np.zeros(len(flat), np.uint64)]
    packed = np.zeros(len(flat), np.uint64)
    for d in range(1, ORDER + 1):
        byte = np.full(len(flat), 32, np.uint64)
        byte[d:] = flat[:-d] if d < len(flat) else flat[:0]
        byte = np.where(place >= d, byte, np.uint64(32))
        packed = np.where(place >= d - 1, packed | (byte << np.uint64(8 * (d - 1))), packed)
        known = np.minimum(place + 1, d).astype(np.uint64)
        out.append(packed | (known << np.uint64(48)))
    return out


class Model:
    """The frozen trees of all languages as sorted arrays: bounded by the training texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        symbols: dict[int, dict] = defaultdict(dict)
        nodes: dict[int, dict] = defaultdict(dict)
        for which, language in enumerate(self.languages):
            words = [w for text in samples[language] for w in _TOKEN.findall(text.lower()) if w not in _BREAKS]
            if not words:
                continue
            flat, _, place = _codes(words)
            for d, context in enumerate(_contexts(flat, place)):
                real = place + 1 >= d
                c, b = context[real], flat[real]
                key, n = np.unique((c << np.uint64(8)) | b, return_counts=True)
                for k, m in zip(key.tolist(), n.tolist(), strict=True):
                    symbols[k][which] = symbols[k].get(which, 0) + m
                    node = nodes[k >> 8].setdefault(which, [0, 0])
                    node[0] += m
                    node[1] += 1
        many = len(self.languages)
        self.node_keys = np.array(sorted(nodes), np.uint64)
        self.escape = np.zeros((len(nodes) + 1, many), np.float32)  # 0: this language doesn't know the context
        for i, k in enumerate(self.node_keys.tolist()):
            for which, (n, d) in nodes[k].items():
                self.escape[i, which] = -np.log2(d / (n + d))
        self.symbol_keys = np.array(sorted(symbols), np.uint64)
        self.cost = np.full((len(symbols) + 1, many), np.inf, np.float32)
        for i, k in enumerate(self.symbol_keys.tolist()):
            for which, c in symbols[k].items():
                n, d = nodes[k >> 8][which]
                self.cost[i, which] = -np.log2(c / (n + d))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, len(keys))

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language, names weighed down."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        flat, owner, place = _codes(words)
        bits = np.full((len(flat), len(self.languages)), 8.0, np.float32)
        for d, context in enumerate(_contexts(flat, place)):
            real = np.flatnonzero(place + 1 >= d)  # a shorter context has had its turn
            node = self._find(self.node_keys, context[real])
            known = node < len(self.node_keys)
            real, node = real[known], node[known]
            symbol = self.cost[self._find(self.symbol_keys, (context[real] << np.uint64(8)) | flat[real])]
            bits[real] = np.where(np.isfinite(symbol), symbol, bits[real] + self.escape[node])
        starts = np.flatnonzero(place == 0)
        total = np.add.reduceat(bits, starts, 0)
        rate = total.min(1) / np.diff(np.append(starts, len(flat)))
        return total * np.where(rate > NAME_BITS, NAME_WEIGHT, 1.0).astype(np.float32)[:, None]


class Words(dict):
    """Word -> row of a growing table of code lengths; breaks are row 0."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update(dict.fromkeys(_BREAKS, 0))
        self.table = np.zeros((1, len(self.model.languages)), np.float32)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        row = self[word] = len(self.table) + len(self.fresh) - 1
        return row

    def lengths(self) -> np.ndarray:
        if self.fresh:
            self.table = np.concatenate([self.table, self.model.code_lengths(self.fresh)])
            self.fresh = []
        return self.table


def tokens(text: str) -> list[str]:
    """Words, Chinese characters and sentence breaks, in lower case, short quotations left out."""
    if not _QUOTES.isdisjoint(text):
        text = _QUOTED.sub(" ", text)
    return _TOKEN.findall(text.lower())


class Judged:
    """The sentences of a batch with their languages: all arrays by sentence."""

    def __init__(self, texts: list[str], words: Words):
        if len(words) > REMEMBERED_WORDS:
            words.clear()
        flat: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            flat += map(words.__getitem__, tokens(text))
            flat.append(0)
            ends[i] = len(flat)
        row = np.array(flat, np.int64)
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
        table = words.lengths()
        sentence = np.cumsum(row == 0) - (row == 0)
        word = row > 0
        self.bits = table[row[word]]
        self.sentence, index = np.unique(sentence[word], return_inverse=True)
        starts = np.flatnonzero(np.append(True, np.diff(index) > 0)) if len(index) else np.empty(0, np.int64)
        self.words = np.bincount(index, minlength=len(self.sentence))
        self.text = text_of[word][starts] if len(starts) else starts
        many = table.shape[1]
        self.sums = np.add.reduceat(self.bits, starts, 0) if len(starts) else np.zeros((0, many), np.float32)
        texts_n = len(texts)
        self.totals = np.zeros((texts_n, many))
        np.add.at(self.totals, self.text, self.sums)
        self.counted = np.bincount(self.text, self.words, texts_n)
        self.text_of_word, self.index = text_of[word], index
        self.evidence(texts_n, many, words.model)

    def evidence(self, texts: int, many: int, model: Model) -> None:
        two = np.sort(self.sums, 1)[:, :2] if many > 1 else np.concatenate([self.sums, self.sums + 99], 1)
        self.best, self.margin = self.sums.argmin(1) if len(self.sums) else np.empty(0, np.int64), two[:, 1] - two[:, 0]
        han = np.array([language == "zh" for language in model.languages])
        needed = np.where(han[self.best], HAN_WORDS, SENTENCE_WORDS) if len(self.best) else np.empty(0)
        sure = (self.margin >= SENTENCE_MARGIN) & (self.words >= needed)
        self.present = np.zeros((texts, many), bool)
        self.present[self.text[sure], self.best[sure]] = True
        self.bits_for, self.words_for = np.zeros((texts, many)), np.zeros((texts, many))
        np.add.at(self.bits_for, (self.text, self.best), self.margin)
        np.add.at(self.words_for, (self.text, self.best), self.words)
        # some words in a row that are another language than their sentence's
        sums = np.cumsum(np.concatenate([np.zeros((1, many)), self.bits.astype(np.float64)]), 0)
        for length, which in ((RUN_WORDS, ~han), (HAN_RUN_WORDS, han)):
            if len(self.bits) < length or not which.any():
                continue
            window = sums[length:] - sums[:-length]
            first = np.arange(len(window))
            inside = self.index[first] == self.index[first + length - 1]
            best = window.argmin(1)
            own = self.best[self.index[first]]
            gain = window[first, own] - window[first, best]
            second = np.partition(window, 1, 1)[:, 1] - window[first, best] if many > 1 else gain
            other = inside & (best != own) & (gain >= RUN_MARGIN) & (second >= SENTENCE_MARGIN) & which[best]
            place = self.text_of_word[first[other]], best[other]
            self.present[place] = True
            np.maximum.at(self.bits_for, place, second[other])
            np.maximum.at(self.words_for, place, length)
        # no sure sentence: the cheapest language of the whole text
        none = ~self.present.any(1) & (self.counted > 0)
        self.present[none, self.totals[none].argmin(1)] = True
        self.unsure = none


def train(samples: DataFrame, labelled: DataFrame | None, rows_per_language: int = TRAINING_ROWS) -> Model:
    """The model from ``samples`` (lang, text) and at most ``rows_per_language`` rows a language of
    ``labelled`` (id, lang, text), drawn by hash; of those only texts whose label the samples confirm."""
    found: dict[str, list[str]] = defaultdict(list)
    for language, text in samples.select("lang", "text").where("lang is not null and text is not null").collect():
        found[language].append(text)
    model = Model(found)
    if labelled is None or not rows_per_language:
        return model
    window = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(11), "id"), "id")
    usable = labelled.where(F.col("lang").isin(list(found)) & F.col("text").isNotNull() & F.col("id").isNotNull())
    ranked = usable.select("id", "lang").withColumn("_rank", F.row_number().over(window))
    drawn = ranked.where(F.col("_rank") <= rows_per_language).select("id").distinct()  # languages * rows_per_language at most
    rows = usable.join(F.broadcast(drawn), "id").select("lang", "text").collect()
    judged = Judged([r[1] for r in rows], Words(model))
    at = {language: i for i, language in enumerate(model.languages)}
    for i, (language, text) in enumerate(rows):
        if judged.present[i].sum() == 1 and judged.present[i, at[language]]:
            found[language].append(text)
    return Model(found)


def text_languages(records: DataFrame, id_col: str, text_col: str, model: Model, least_items: int = 5) -> DataFrame:
    """``(id, lang, confidence, words)``: one row per record and language of its text.

    ``confidence`` is the posterior of the language over the sentences it is the cheapest for, or else over
    its clearest run of words, against the best other one; ``words`` are those of the sentences or the run. Null and blank texts, texts of fewer than ``least_items`` distinct items and texts
    without a word give no row; repeated ids give a row each time they stand; very long texts are read
    whole; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for kept, judged in _judged(batches, shared.value, least_items):
            at, which = np.nonzero(judged.present)
            confidence = 1 / (1 + np.exp2(-np.clip(judged.bits_for[at, which], 0, 60)))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0).take(pa.array(at)), pa.array(names[which].tolist(), pa.string()), pa.array(confidence), pa.array(judged.words_for[at, which].astype(np.int64))],
                names=["id", "lang", "confidence", "words"],
            )

    rows = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, "id bigint, lang string, confidence double, words bigint")


def _judged(batches: Iterator[pa.RecordBatch], model: Model, least_items: int) -> Iterator[tuple[pa.RecordBatch, Judged]]:
    """The rows (id, text, ...) of each batch whose text has enough items, judged together."""
    words = Words(model)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        enough = [len(set(items(text))) >= least_items for text in texts]
        kept = batch.filter(pa.array(enough, pa.bool_()))
        if kept.num_rows:
            yield kept, Judged([t for t, e in zip(texts, enough, strict=True) if e], words)


def language_segments(records: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``(id, number, start, length, lang, confidence)``: each text cut into stretches of one language.

    A stretch may begin inside a sentence. Positions count code points, from 0; the stretches of a text
    cover it; spaces and marks between two stretches belong to the first. ``confidence`` is the posterior
    of the stretch's language against the best other one. Null ids and texts and texts without a word give no row; repeated ids
    give their rows each time they stand; very long texts are read whole; an empty table gives no rows.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        names = np.array(shared.value.languages, object)
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT_TEXTS):
                ids, texts = (batch.column(c).slice(at, SEGMENT_TEXTS) for c in (0, 1))
                text, number, start, length, language, confidence = stretches(texts.to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text)), *(pa.array(x.astype(np.int32)) for x in (number, start, length)), pa.array(names[language].tolist(), pa.string()), pa.array(confidence)],
                    names=["id", "number", "start", "length", "lang", "confidence"],
                )

    rows = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, "id bigint, number int, start int, length int, lang string, confidence double")


#: Texts whose paths are found together.
SEGMENT_TEXTS = 2048


def _placed_words(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its text, place, row in the table, and whether a sentence break stands before it."""
    if len(words) > REMEMBERED_WORDS:
        words.clear()
    rows: list[int] = []
    starts: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not _QUOTES.isdisjoint(text):
            text = _QUOTED.sub(lambda m: " " * len(m.group()), text)
        before = len(rows)
        for m in _TOKEN.finditer(text):
            rows.append(words[m.group().lower()])
            starts.append(m.start())
        counts[i] = len(rows) - before
    row, start, owner = np.array(rows, np.int64), np.array(starts, np.int64), np.repeat(np.arange(len(texts)), counts)
    word = np.flatnonzero(row > 0)
    breaks = np.cumsum(row == 0)[word]
    return owner[word], start[word], row[word], np.append(True, breaks[1:] != breaks[:-1])[: len(word)]


def cheapest_path(bits: np.ndarray, owner: np.ndarray, after_break: np.ndarray) -> np.ndarray:
    """The language of each word on the cheapest path through each text's words, all texts step by step."""
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    length = np.diff(np.append(begin, len(owner)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    price = np.where(after_break, SENTENCE_MARGIN / 2, RUN_MARGIN / 2)
    came = np.empty(bits.shape, np.int8)
    stay = np.arange(bits.shape[1], dtype=np.int8)
    cost = np.zeros((len(begin), bits.shape[1]))
    path = np.empty(len(owner), np.int8)
    most = int(length[0]) if len(length) else 0
    open_ = np.searchsorted(-length, -np.arange(most), "left")  # texts that have a word at this step
    for step in range(most):
        n = open_[step]
        at = begin[:n] + step
        if step:
            source = cost[:n].argmin(1)
            change = cost[np.arange(n), source] + price[at]
            moves = change[:, None] < cost[:n]
            came[at] = np.where(moves, source[:, None].astype(np.int8), stay)
            cost[:n] = np.where(moves, change[:, None], cost[:n])
        cost[:n] += bits[at]
    now = cost.argmin(1).astype(np.int8)
    for step in range(most - 1, -1, -1):
        n = open_[step]
        at = begin[:n] + step
        path[at] = now[:n]
        if step:
            now[:n] = came[at, now[:n]]
    return path


def stretches(texts: list[str], words: Words) -> tuple[np.ndarray, ...]:
    """(text, number, start, length, language, confidence) of the stretches of some texts, put together."""
    owner, place, row, after_break = _placed_words(texts, words)
    bits = words.lengths()[row]
    path = cheapest_path(bits, owner, after_break)
    han = np.array([language == "zh" for language in words.model.languages])
    for _ in range(2):  # what is too short to tell joins its neighbour; twice, as that may join two more
        new = np.append(True, (owner[1:] != owner[:-1]) | (path[1:] != path[:-1]))[: len(owner)]
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(owner)))
        short = length < np.where(han[path[first]], HAN_WORDS, SENTENCE_WORDS)
        same_before = np.append(False, owner[first[1:]] == owner[first[:-1]])[: len(first)]
        same_behind = np.append(same_before[1:], False)[: len(first)]
        joined = np.where(same_before, np.roll(path[first], 1), np.roll(path[first], -1))
        change = short & (same_before | same_behind)
        path = np.repeat(np.where(change, joined, path[first]), length)
    new = np.append(True, (owner[1:] != owner[:-1]) | (path[1:] != path[:-1]))[: len(owner)]
    first = np.flatnonzero(new)
    text, language = owner[first], path[first].astype(np.int64)
    head = np.append(True, text[1:] != text[:-1])[: len(text)]
    begin = np.where(head, 0, place[first])
    sizes = np.array([len(t) for t in texts], np.int64)
    last = np.append(head[1:], True)[: len(text)]
    end = np.where(last, sizes[text], np.append(begin[1:], 0)[: len(text)])
    heads = np.flatnonzero(head)
    number = np.arange(len(text)) - np.repeat(heads, np.diff(np.append(heads, len(text))))
    sums = np.add.reduceat(bits.astype(np.float64), first, 0) if len(first) else np.zeros((0, bits.shape[1]))
    own = sums[np.arange(len(first)), language]
    sums[np.arange(len(first)), language] = np.inf
    margin = np.clip(sums.min(1) - own, 0, 60) if sums.shape[1] > 1 else np.full(len(first), 60.0)
    return text, number, begin, end - begin, language, 1 / (1 + np.exp2(-margin))


def label_cases(records: DataFrame, id_col: str, text_col: str, label_col: str, forms: DataFrame, model: Model, least_items: int = 5) -> DataFrame:
    """``(id, lang)`` of the records whose label is missing, names no language or another one than the
    text's, or whose text mixes languages: one row per language of the text.

    The label travels with its text, nothing is shuffled. Repeated ids are judged each by themselves.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for kept, judged in _judged(batches, shared.value, least_items):
            named = np.array(kept.column(2).to_pylist(), object)
            best = names[judged.present.argmax(1)]
            case = (judged.present.sum(1) > 1) | (judged.present.any(1) & (best != named))  # no label is another one
            at, which = np.nonzero(judged.present & case[:, None])
            yield pa.RecordBatch.from_arrays([kept.column(0).take(pa.array(at)), pa.array(names[which].tolist(), pa.string())], names=["id", "lang"])

    known = forms.select("label_form", F.col("lang").alias("named")).where("label_form is not null").groupBy("label_form").agg(F.min("named").alias("named"))
    rows = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label_form")).where("id is not null and text is not null")
    labelled = rows.join(F.broadcast(known), "label_form", "left")  # a fixed list of labels
    return labelled.select("id", "text", "named").mapInArrow(run, "id bigint, lang string")
