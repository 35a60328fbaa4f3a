"""BPE encoding and decoding with tree concatenation.

A text is halved anywhere, down to leaves, the leaves are encoded by themselves, and
neighbours are joined in a tree: a window around the cut is encoded anew and grows
until its first and last part agree exactly with both sides. Texts up to a size are
halved within a task; the halves of longer ones are dealt over all tasks and each
level of their tree is a step of its own. The parts of a window are runs without white
space, since the tokenizer drops white space and none of its words holds any; so a
window that agrees is never influenced from outside. Frequent runs are remembered
within a task.

A text with a very long run is encoded apart: there the parts are tokens. The run's
words (as the pre-tokenizer cuts them) that are still too long are halved down to
leaves, the leaves are dealt over all tasks, and neighbours are joined until a
window's first and last token agree. Then every two neighbouring tokens are what BPE
makes of their own text, so the joined list is what BPE makes of the whole word.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stored, table

TOKENIZER = "word_bpe_49k.json"
#: Characters of a run, and of a leaf, that are encoded in one piece.
LEAF = 2048
#: Characters of a text whose tree is made within one task; halves of longer ones are dealt.
DEALT = 1 << 16
#: Runs that a task remembers; then it starts afresh.
REMEMBERED = 400_000
#: Unicode white space, which is what the tokenizer's normaliser takes for it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters up to U+017F are their own NFC form and have kept their categories
#: since Unicode 1.1, so runs of them can be cut here as the tokenizer cuts them.
#: (U+0130 has a lower case of two characters and is left to the tokenizer.)
_PLAIN = [chr(c) for c in range(0x21, 0x180) if c != 0x130 and not chr(c).isspace() and not 0x7F <= c < 0xA0]
_LETTER = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBER = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_SIMPLE = re.compile(f"[{re.escape(''.join(_PLAIN))}]+")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_SPECIAL = "<|"


def _byte_letters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_letters()
_GAP = re.compile(f"[{SPACES}]+")
#: str.split() cuts at these too, the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def runs(text: str) -> list[str]:
    """The text's runs without white space."""
    if any(c in text for c in _ODD):
        return [x for x in _GAP.split(text) if x]
    return text.split()


class Codec:
    """A tokenizer file's encoder and decoder. For files with a BPE model with word ends and no decoder."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        parsed = json.loads(spec)
        model = parsed["model"]
        if model["type"] != "BPE" or parsed["decoder"] is not None or parsed["post_processor"] is not None:
            raise ValueError("only BPE models without decoder and post-processor")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.whole = self.tokenizer.model
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self.known: dict[str, tuple[str, str]] = {}

    def learn(self, new: list[str]) -> None:
        for run in new:
            if len(run) <= LEAF and _SIMPLE.fullmatch(run) and _SPECIAL not in run:
                pairs = [self.known.get(w) or self.word(w) for w in _WORD.findall(run.lower())]
                self.ids[run] = " ".join([a for a, _ in pairs])
                self.texts[run] = " ".join([b for _, b in pairs])
            else:
                ids = self.tokenizer.encode(run, add_special_tokens=False).ids
                self.ids[run] = " ".join(map(str, ids))
                self.texts[run] = " ".join(map(self.tokenizer.id_to_token, ids))

    def word(self, word: str) -> tuple[str, str]:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        tokens = self.whole.tokenize(letters)
        self.known[word] = found = " ".join([str(t.id) for t in tokens]), " ".join([t.value for t in tokens])
        return found

    def encode_runs(self, own: list[str]) -> tuple[list[str], list[str]]:
        """The ids in decimal, joined by one space, and the decoded text of each run; runs are encoded whole."""
        new = [r for r in dict.fromkeys(own) if r not in self.ids]
        if new:
            if len(self.ids) + len(self.known) > REMEMBERED:
                self.ids.clear()
                self.texts.clear()
                self.known.clear()
                new = list(dict.fromkeys(own))
            self.learn(new)
        return list(map(self.ids.__getitem__, own)), list(map(self.texts.__getitem__, own))

    def encode(self, text: str, leaf: int) -> tuple[str, str]:
        """The ids in decimal and the decoded text, each joined by one space."""
        found = halved(self, text, leaf)
        return " ".join(found.ids), " ".join(found.texts)

    def words(self, run: str) -> list[str] | None:
        """The words of a run as the model gets them; None if the run has a special token."""
        if any(t.content in run for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(run))]

    def leaf(self, piece: str, last: bool) -> list[int]:
        """The ids of a piece of a word; only the last piece gets the word's end."""
        return [t.id for t in (self.whole if last else self.inner).tokenize(piece)]

    def surface(self, ids: list[int], last: bool) -> str:
        text = "".join(map(self.tokenizer.id_to_token, ids))
        return text.removesuffix(self.suffix) if last and self.suffix else text

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The ids of two neighbouring stretches' whole text; `last`: right ends the word."""
        size = 1
        while True:
            own_left, own_right = left[-size:], right[:size]
            all_left, all_right = size >= len(left), size >= len(right)
            ends = last and all_right
            new = self.leaf(self.surface(own_left, False) + self.surface(own_right, ends), ends)
            if (all_left or new[0] == own_left[0]) and (all_right or new[-1] == own_right[-1]):
                return left[: len(left) - len(own_left)] + new + right[len(own_right) :]
            size *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """The ids of a word from those of its leaves, pairs first, then pairs of pairs."""
        while len(parts) > 1:
            n = len(parts)
            parts = [self.join(parts[i], parts[i + 1], i + 2 >= n) if i + 1 < n else parts[i] for i in range(0, n, 2)]
        return parts[0]


@dataclass
class Stretch:
    """A stretch of a text: its runs, their ids and decoded texts, and whether its first and last run may go on beyond it."""

    runs: list[str]
    ids: list[str]
    texts: list[str]
    open_left: bool
    open_right: bool


def stretch(codec: Codec, text: str) -> Stretch:
    own = runs(text)
    ids, texts = codec.encode_runs(own)
    # a run reaches the end of the stretch if there is no white space
    return Stretch(own, ids, texts, bool(own) and text.startswith(own[0]), bool(own) and text.endswith(own[-1]))


def joined(codec: Codec, left: Stretch, right: Stretch) -> Stretch:
    """The stretch of both texts. A cut within a run is mended by windows of runs that grow until both sides agree."""
    if left.open_right and right.open_left:
        size = 1
        while True:
            a, b = left.runs[-size:], right.runs[:size]
            window = [*a[:-1], a[-1] + b[0], *b[1:]]
            ids, texts = codec.encode_runs(window)
            all_left, all_right = size >= len(left.runs), size >= len(right.runs)
            if (all_left or ids[0] == left.ids[-size]) and (all_right or ids[-1] == right.ids[size - 1]):
                break
            size *= 2
        parts = [[*x[: len(x) - len(a)], *new, *y[len(b) :]] for x, new, y in ((left.runs, window, right.runs), (left.ids, ids, right.ids), (left.texts, texts, right.texts))]
    else:
        parts = [x + y for x, y in ((left.runs, right.runs), (left.ids, right.ids), (left.texts, right.texts))]
    return Stretch(*parts, left.open_left, right.open_right)


def halved(codec: Codec, text: str, leaf: int) -> Stretch:
    """The stretch of a text by tree concatenation."""
    if len(text) <= leaf:
        return stretch(codec, text)
    middle = len(text) // 2
    return joined(codec, halved(codec, text[:middle], leaf), halved(codec, text[middle:], leaf))


@lru_cache(maxsize=2)
def _codec(spec: str) -> Codec:
    return Codec(spec)


def halves(word: str, leaf: int = LEAF) -> list[str]:
    """The word's leaves: halves of halves, each of at most `leaf` characters."""
    if len(word) <= leaf:
        return [word]
    middle = len(word) // 2
    return halves(word[:middle], leaf) + halves(word[middle:], leaf)


def _encode_short(spec, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                both = [codec.encode(t or "", leaf) for t in part.column(1).to_pylist()]
                ids, texts = pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], ["doc_id", "ids", "decoded"])

    return run


STRETCH = "doc_key string, seq long, parts long, runs array<string>, ids array<string>, texts array<string>, open_left boolean, open_right boolean"


def _pieces(dealt: int):
    """Rows (doc_key, seq, parts, piece): a text's halves of halves, alike in number on all sides."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["doc_key"], frame["text"]):
                parts = [text]
                while max(map(len, parts)) > dealt:
                    parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
                for at in range(0, len(parts), 100):
                    some = parts[at : at + 100]
                    yield pd.DataFrame({"doc_key": [key] * len(some), "seq": range(at, at + len(some)), "parts": [len(parts)] * len(some), "piece": some})

    return run


def _encode_pieces(spec, leaf: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value)
        for frame in frames:
            for key, seq, parts, piece in zip(frame["doc_key"], frame["seq"], frame["parts"], frame["piece"]):
                found = halved(codec, piece, leaf)
                yield pd.DataFrame({"doc_key": [key], "seq": [seq], "parts": [parts], **{k: [v] for k, v in vars(found).items()}})

    return run


def _join_level(spec):
    """Two neighbours of a level, or the one that is left, to a row of the next."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(spec.value)
        frame = frame.sort_values("seq")
        found = [Stretch(list(r.runs), list(r.ids), list(r.texts), bool(r.open_left), bool(r.open_right)) for r in frame.itertuples()]
        whole = joined(codec, *found) if len(found) == 2 else found[0]
        return pd.DataFrame({"doc_key": [frame["doc_key"].iloc[0]], "seq": [frame["seq"].iloc[0] // 2], "parts": [(frame["parts"].iloc[0] + 1) // 2], **{k: [v] for k, v in vars(whole).items()}})

    return run


def _dealt_trees(whole: DataFrame, spec, leaf: int, dealt: int) -> DataFrame:
    """doc_key, ids, decoded of whole (doc_key, text): leaves and each level's joins are dealt over all tasks."""
    pieces = whole.select("doc_key", "text").mapInPandas(_pieces(dealt), "doc_key string, seq long, parts long, piece string")
    level = stored(pieces.repartition("doc_key", "seq").mapInPandas(_encode_pieces(spec, leaf), STRETCH), "level")
    most = level.agg(F.max("parts")).first()[0] or 0
    while most > 1:
        level = stored(level.groupBy("doc_key", F.floor(F.col("seq") / 2).alias("pair")).applyInPandas(_join_level(spec), STRETCH), "level")
        most = (most + 1) // 2
    return level.select("doc_key", F.array_join("ids", " ").alias("ids"), F.array_join("texts", " ").alias("decoded"))


def _cut(spec, leaf: int):
    """Rows (doc_key, seq, part, parts, piece, ids): leaves have a piece, the rest has ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value)
        for frame in frames:
            for key, text in zip(frame["doc_key"], frame["text"]):
                rows: list[tuple] = []
                plain: list[str] = []

                def flush(key=key, rows=rows, plain=plain):
                    if plain:
                        rows.append((key, len(rows), 0, 0, None, [i for r in plain for i in codec.tokenizer.encode(r, add_special_tokens=False).ids]))
                        plain.clear()

                for r in runs(text):
                    words = codec.words(r) if len(r) > leaf else None
                    if words is None or max(map(len, words), default=0) <= leaf:
                        plain.append(r)
                        continue
                    flush()
                    seq = len(rows)
                    for w in words:
                        seq += 1
                        cut = halves(w, leaf)
                        rows += [(key, seq, k, len(cut), piece, None) for k, piece in enumerate(cut)]
                flush()
                ordered = [(k, n, part, parts, piece, ids) for n, (k, _, part, parts, piece, ids) in enumerate(rows)]
                for at in range(0, len(ordered), 1000):
                    yield pd.DataFrame(ordered[at : at + 1000], columns=["doc_key", "seq", "part", "parts", "piece", "ids"])

    return run


def _encode_leaves(spec):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value)
        for frame in frames:
            frame["ids"] = [ids if piece is None else codec.leaf(piece, part + 1 == parts) for ids, piece, part, parts in zip(frame["ids"], frame["piece"], frame["part"], frame["parts"])]
            yield frame[["doc_key", "seq", "part", "parts", "ids"]]

    return run


def _concatenate(spec):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(spec.value)
        frame = frame.sort_values("seq")
        out: list[int] = []
        word: list[list[int]] = []
        for part, parts, ids in zip(frame["part"], frame["parts"], frame["ids"]):
            if parts < 2:
                out += list(map(int, ids))
                continue
            word.append(list(map(int, ids)))
            if part + 1 == parts:
                out += codec.tree(word)
                word = []
        tokens = " ".join(map(codec.tokenizer.id_to_token, out))
        return pd.DataFrame({"doc_key": [frame["doc_key"].iloc[0]], "ids": [" ".join(map(str, out))], "decoded": [tokens]})

    return run


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, dealt: int = DEALT) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space), decoded, of every row of docs (doc_id, text).

    Null is the empty text: no tokens. Repeated rows stay repeated. The
    tokenizer's own truncation and padding are off and no special tokens are
    added; a special token's string in a text is that token. Other columns are ignored."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())  # as large as the vocabulary
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    unsplit = F.coalesce(F.col("text").rlike(rf"[^\x20\x09-\x0D]{{{leaf + 1}}}"), F.lit(False))
    apart = F.coalesce(F.length("text") > dealt, F.lit(False)) | unsplit
    both = arrow_map(docs.where(~apart), _encode_short(spec, leaf), "doc_id long, ids string, decoded string")
    long = stored(docs.where(apart).withColumn("unsplit", unsplit), "long")
    if not long.isEmpty():
        whole = long.groupBy("doc_id", "text", "unsplit").agg(F.count("*").alias("times")).withColumn("doc_key", F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256))
        whole = stored(whole, "whole")
        pieces = whole.where("unsplit").select("doc_key", "text").mapInPandas(_cut(spec, leaf), "doc_key string, seq long, part long, parts long, piece string, ids array<int>")
        leaves = pieces.repartition("doc_key", "seq").mapInPandas(_encode_leaves(spec), "doc_key string, seq long, part long, parts long, ids array<int>")
        found = leaves.groupBy("doc_key").applyInPandas(_concatenate(spec), "doc_key string, ids string, decoded string")
        found = stored(found.unionByName(_dealt_trees(whole.where("NOT unsplit"), spec, leaf, dealt)), "found")
        back = whole.select("doc_id", "doc_key", "times").join(found, "doc_key", "left").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        both = both.unionByName(back.select("doc_id", F.coalesce("ids", F.lit("")).alias("ids"), F.coalesce("decoded", F.lit("")).alias("decoded")))
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.translate("ids", " ", "")) + 1)
    return both.select("doc_id", n.cast("long").alias("n_tokens"), "ids", "decoded")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids as array<int>, decoded_sha256, of every row of docs."""
    found = encode(docs)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return found.select("doc_id", "n_tokens", ids.alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))
