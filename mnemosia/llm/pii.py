"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a trained classifier decides.

Candidates are spans of five kinds: addresses, numbers of machines, cards and telephones, and names of persons. On each
candidate the labelers below vote for, against or not at all: its pattern, a checksum or structure, a gazetteer, words
before it, words after it, other candidates near it, and how it is set off. Votes are counted by kind and pattern of
votes over all texts (at most 3 ** 7 patterns a kind), and expectation-maximisation over these counts estimates how
often each labeler is right, for each kind, and with that the probability of each pattern. A logistic model over the
span's own features (its shape and hashed words around it, not the votes) learns these probabilities on a sample of
at most SAMPLE_ROWS candidates, those of least hash, so the same whatever the partitions. It scores every candidate of every text.

Spans are base spans, which follow fixed patterns and always stay, and what the classifier adds: candidates of
probability THRESHOLD or more that overlap no base span of their kind; of two that overlap in one kind the likelier
stays, then the earlier.

Defined results: null and empty text have no spans and the digest of an empty list. Texts are read whole, in time linear
in their length. Equal rows give equal rows, ties of probability go to the earlier span. With no candidates there is no
model and nothing is added; an empty table gives no row. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stored, table

#: Kinds, in the order of the list of spans; the last has no base pattern.
KINDS = ("email", "ip", "card", "phone", "name")
#: Candidates that the classifier learns from at most; its hashed features; the probability from which a span is added; rounds.
SAMPLE_ROWS, FEATURES, THRESHOLD, EM_ROUNDS, FIT_ROUNDS = 50_000, 4096, 0.5, 60, 150
#: How often a card number has a right check digit and another number a wrong one, as the prior has it.
CHECK_DIGIT = 0.97
#: Characters around a candidate in which words are read, and in which another candidate counts as near.
AROUND, NEAR = 60, 120

#: Common given names, endings of hosts, titles, words that tell a kind or speak against it.
GIVEN_NAMES = """
anna maria john james robert michael william david mary patricia jennifer linda elizabeth barbara susan jessica sarah karen
thomas charles daniel matthew anthony mark paul steven andrew peter hans klaus jürgen wolfgang stefan andreas monika petra
sabine ursula jean pierre michel philippe nicolas marie nathalie isabelle sophie camille josé juan carlos luis miguel
antonio francisco carmen ana isabel laura lucía elena sofia emma olivia noah liam lucas julia martin alice
""".split()
HOST_ENDINGS = "com org net edu gov int de fr es uk eu at ch it nl be pt us ca au in jp io info biz".split()
TITLES = "mr mrs ms dr prof herr frau monsieur madame señor señora sr sra".split()
CUES = {
    "email": "mail email e-mail contact write address reach correo courriel kontakt".split(),
    "ip": "ip host server address client peer from addr ping login".split(),
    "card": "card visa mastercard amex credit debit payment karte tarjeta carte pan number".split(),
    "phone": "phone call tel telephone mobile cell fax telefon teléfono téléphone anruf contact ring".split(),
    "name": [*TITLES, "name", "named", "am", "i'm", "dear", "sincerely", "signed", "patient", "author", "by", "heiße", "heisst", "llamo", "appelle", "hello", "hi"],
}
AGAINST = "version v release isbn issn sku order invoice section chapter table figure sha md5 commit build page license public apache".split()

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where its run of digits begins, since every match before it ended at the end of one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9][\w.+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_NAME = re.compile(r"(?<!\w)[^\W\d_a-zß-öø-ÿ]\w{1,19}\.?(?: [^\W\d_a-zß-öø-ÿ][\w'-]{1,29}){1,2}(?!\w)")
_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
_GIVEN, _TITLES, _ENDINGS, _AGAINST = set(GIVEN_NAMES), set(TITLES), set(HOST_ENDINGS), set(AGAINST)
_CUES = {k: set(v) for k, v in CUES.items()}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, each read from its @."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = done + len(text[done:at].rstrip(_LOCAL))
        end = _DOMAIN.match(text, at + 1) if begin < at else None
        if end:
            yield begin, end.end()
        at = done = end.end() if end else at + 1


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the spans that follow the fixed patterns."""
    found = [(0, b, e) for b, e in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part, m.group().split(".")))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and wider forms, sorted; a wider form that overlaps a base span of its kind is left out."""
    wide = [(0, *m.span()) for m in _SPELLED.finditer(text)] if "(at)" in text or "[at]" in text or "{at}" in text else []
    wide += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(_digits(m.group())) <= 19]
    wide += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    wide += [(4, *m.span()) for m in _NAME.finditer(text) if not _GIVEN.isdisjoint(w := m.group().lower().replace(".", "").split(" ")) or w[0] in _TITLES]
    out = sorted(base)
    for k, b, e in sorted(wide):
        if not any(k == k2 and b < e2 and b2 < e for k2, b2, e2 in _about(base, k, b, e)):
            out.append((k, b, e))
    return sorted(set(out))


def _about(base: list[tuple[int, int, int]], kind: int, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """The base spans of a kind that can touch begin:end; base is in the order of kinds and starts."""
    from bisect import bisect_left

    at = max(0, bisect_left(base, (kind, begin, 0)) - 1)
    while at < len(base) and base[at][0] <= kind and (base[at][0] < kind or base[at][1] < end):
        yield base[at]
        at += 1


def votes(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, ...]], list[tuple[list[str], list[str]]]]:
    """(for each span, which are sorted by kind: seven votes of -1, 0 or 1; the words before and after it)."""
    order = sorted(range(len(spans)), key=lambda i: spans[i][1:])
    near = [0] * len(spans)
    for x, y in zip(order, order[1:]):
        if spans[y][1] - spans[x][2] <= NEAR and spans[x][0] != spans[y][0]:
            near[x] = near[y] = 1
    out, words = [], []
    for i, (k, b, e) in enumerate(spans):
        own = text[b:e]
        digits = _digits(own)
        before = [w.lower() for w in _WORD.findall(text[max(0, b - AROUND) : b])][-5:]
        after = [w.lower() for w in _WORD.findall(text[e : e + AROUND])][:3]
        parts = re.split(r"[^\w]+", own.lower())
        if k == 0:
            shape, sum_, known = 1 if "@" in own else 0, 1 if re.search(r"\.[A-Za-z]{2,}$", own) else -1, 1 if parts[-1] in _ENDINGS else 0
        elif k == 1:
            shape, sum_ = 1, -1 if any(len(p) > 1 and p[0] == "0" for p in parts) or parts[0] == "0" else 1
            known = 1 if parts[0] in ("10", "127", "192", "172") else 0
        elif k == 2:
            shape, sum_, known = 1 if len(digits) in (15, 16) else 0, 1 if luhn(digits) else -1, 1 if digits[0] in "3456" else -1
        elif k == 3:
            shape, sum_, known = 1 if own[0] == "+" else 0, 1 if 10 <= len(digits) <= 13 else -1, 1 if digits[0] in "123456789" else -1
        else:
            names = own.lower().replace(".", "").split(" ")
            shape, sum_ = 1 if names[0] in _TITLES else 0, -1 if len(set(names)) < len(names) or own.isupper() else 0
            known = 1 if names[0] in _GIVEN or len(names) > 2 and names[1] in _GIVEN else -1
        cue = 1 if not _CUES[KINDS[k]].isdisjoint(before) else -1 if not _AGAINST.isdisjoint(before[-2:]) else 0
        behind = -1 if not _AGAINST.isdisjoint(after[:1]) else 0
        free = (b == 0 or not (text[b - 1].isalnum() or text[b - 1] in "_/=.-")) and (e == len(text) or not (text[e].isalnum() or text[e] in "_/="))
        out.append((shape, sum_, known, cue, behind, near[i], 1 if free else -1))
        words.append((before[-2:], after[:1]))
    return out, words


def features(text: str, span: tuple[int, int, int], words: tuple[list[str], list[str]]) -> list[int]:
    """Hashed features of a span's shape and of the words around it, each with its kind."""
    k, b, e = span
    own = text[b:e]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", lambda m: "9" * min(4, m.end() - m.start()), own[:80]))
    digits = _digits(own)
    names = [
        "kind", f"shape {shape}", f"digits {min(20, len(digits))}", f"first {digits[:1]}", f"length {min(40, e - b) // 4}", f"end {own.lower().rsplit('.', 1)[-1][:8] if k == 0 else ''}",
        f"luhn {luhn(digits) if k == 2 else ''}", f"left {text[b - 1] if b else ''}", f"right {text[e] if e < len(text) else ''}",
        *[f"before {w}" for w in words[0]], *[f"after {w}" for w in words[1]], *([f"word {w}" for w in own.lower().split(" ")[:3]] if k == 4 else []),
    ]
    return sorted({zlib.crc32(f"{k} {n}".encode()) % FEATURES for n in names})


def _code(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


FOUND = "row struct<{0}>, base array<struct<kind:int,start:int,end:int>>, more array<struct<kind:int,start:int,end:int,votes:int,features:array<int>>>, own array<struct<kind:int,votes:int,features:array<int>>>"


def scan(df: DataFrame, column: str = "text") -> DataFrame:
    """One row for each row of df: row (its other columns), base spans, more (candidates besides, with votes and features), own (votes and features of base spans)."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    packed = df.select(F.coalesce(F.col(column), F.lit("")).alias("t"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != column]).alias("row"))
    span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    extra = [("votes", pa.int32()), ("features", pa.list_(pa.int32()))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_rows, more_rows, own_rows = [], [], []
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                spans = candidates(text, base)
                mine = set(base)
                ballots, words = votes(text, spans) if spans else ([], [])
                rows = [{"kind": s[0], "start": s[1], "end": s[2], "votes": _code(v), "features": features(text, s, w)} for s, v, w in zip(spans, ballots, words)]
                base_rows.append([{"kind": k, "start": b, "end": e} for k, b, e in base])
                more_rows.append([r for r, s in zip(rows, spans) if s not in mine])
                own_rows.append([{c: r[c] for c in ("kind", "votes", "features")} for r, s in zip(rows, spans) if s in mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(base_rows, pa.list_(pa.struct(span))), pa.array(more_rows, pa.list_(pa.struct(span + extra))), pa.array(own_rows, pa.list_(pa.struct([span[0], *extra])))], ["row", "base", "more", "own"]
            )

    rest = _parse_datatype_string(FOUND.split(", ", 1)[1])
    return arrow_map(packed, find, StructType([StructField("row", packed.schema["row"].dataType), *rest.fields]))


def weigh(counts: dict[tuple[int, int], int], n_votes: int = 7) -> tuple[dict[tuple[int, int], float], dict[int, np.ndarray]]:
    """EM over counts of (kind, code of votes): (probability that a span with these votes is personal data; for each kind the
    probabilities of each labeler's vote given class: [class, labeler, vote + 1]).

    Labelers are independent given the class. Starts from the sum of votes; every estimate is smoothed by a prior that is
    as heavy as a tenth of the votes and right seven times in ten, so labelers that say nothing of a kind stay neutral. The
    check digit of a card is arithmetic: its prior is as heavy as all votes and right CHECK_DIGIT of the time."""
    found: dict[tuple[int, int], float] = {}
    tables: dict[int, np.ndarray] = {}
    for kind in sorted({k for k, _ in counts}):
        codes = sorted(c for k, c in counts if k == kind)
        n = np.array([counts[kind, c] for c in codes], float)
        cast = np.array([[c // 3**j % 3 for j in reversed(range(n_votes))] for c in codes])
        signed = cast - 1
        p = 1 / (1 + np.exp(-signed.sum(axis=1)))
        for _ in range(EM_ROUNDS):
            share = (n @ p + 1) / (n.sum() + 2)
            theta = np.empty((2, n_votes, 3))
            for side, weight in ((1, n * p), (0, n * (1 - p))):
                lean = np.tile([0.15, 0.5, 0.35] if side else [0.35, 0.5, 0.15], (n_votes, 1)) * (1 + n.sum() / 10)
                if KINDS[kind] == "card":
                    right, wrong = CHECK_DIGIT, 1 - CHECK_DIGIT
                    lean[1] = np.array([wrong, 1e-6, right] if side else [right, 1e-6, wrong]) * (1 + n.sum())
                for v in range(3):
                    theta[side, :, v] = ((cast == v) * weight[:, None]).sum(axis=0) + lean[:, v]
                theta[side] /= theta[side].sum(axis=1, keepdims=True)
            logit = np.log(share / (1 - share)) + sum(np.log(theta[1, j, cast[:, j]] / theta[0, j, cast[:, j]]) for j in range(n_votes))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        tables[kind] = theta
        found |= {(kind, c): float(q) for c, q in zip(codes, p)}
    return found, tables


def learn(rows: list[list[int]], target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic model over hashed features (full gradients with a step for each feature, L2 0.01)."""
    w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    for _ in range(FIT_ROUNDS if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[column], len(rows)), -30, 30)))
        gradient = np.bincount(column, ((p - target) * weight)[at], FEATURES) / weight.sum() + 0.0001 * w
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
    return w


def train(found: DataFrame) -> np.ndarray | None:
    """The classifier's weights from a stored table of scan(); None without candidates."""
    every = found.select(F.explode(F.concat(F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["votes"].alias("votes"), s["features"].alias("features"))), "own")).alias("c")).select("c.*")
    counts = {(r.kind, r.votes): r.n for r in every.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}  # at most 5 * 3 ** 7 rows
    if not counts:
        return None
    chance, _ = weigh(counts)
    pick = F.xxhash64("kind", "votes", "features")
    sample = every.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).orderBy(pick, "kind", "votes", "features").limit(SAMPLE_ROWS).toArrow()
    keys = list(zip(sample.column("kind").to_pylist(), sample.column("votes").to_pylist()))
    # a thousand copies of one candidate say little more than one
    return learn(sample.column("features").to_pylist(), np.array([chance[k] for k in keys]), np.log2(1.0 + np.array(sample.column("n").to_pylist(), float)))


def chosen(more: list[dict], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The candidates that the classifier takes, without overlaps within a kind."""
    scored = [(-float(weights[s["features"]].sum()), s["kind"], s["start"], s["end"]) for s in more]
    limit = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    out: list[tuple[int, int, int]] = []
    from bisect import bisect_left, insort

    for score, k, b, e in sorted(scored):
        if -score < limit:
            break
        at = bisect_left(out, (k, b, e))
        left, right = out[at - 1] if at else None, out[at] if at < len(out) else None
        if not (left and left[0] == k and left[2] > b) and not (right and right[0] == k and right[1] < e):
            insort(out, (k, b, e))
    return out


def find_pii(df: DataFrame, column: str = "text") -> DataFrame:
    """df's columns but `column` in a struct `row`, base and spans (arrays of kind, start, end; sorted by kind and start)."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    found = stored(scan(df, column), "candidates")
    weights = train(found)
    if weights is None:
        weights = np.zeros(FEATURES)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist()):
                every = sorted([(s["kind"], s["start"], s["end"]) for s in base] + (chosen(more, weights) if more else []))
                spans.append([{"kind": k, "start": b, "end": e} for k, b, e in every])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("base"), pa.array(spans, span)], ["row", "base", "spans"])

    kinds = _parse_datatype_string("base array<struct<kind:int,start:int,end:int>>, spans array<struct<kind:int,start:int,end:int>>")
    return arrow_map(found.select("row", "base", "more"), decide, StructType([StructField("row", found.schema["row"].dataType), *kinds.fields]))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("row.doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
