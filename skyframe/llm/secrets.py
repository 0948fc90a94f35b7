"""Secrets in documents: fixed patterns, and strings that look random by a test battery.

A candidate is a string of 20 or more letters, digits and +/_- that holds a letter. It is
a whole token, a part of one between separators (a key may follow a path or an id, and a
token that mixes + or / with - or _ fits no alphabet), or what base spans leave of one;
only what a base span covers whole is no candidate. Its encoding is inferred from the
characters it uses. Under that alphabet three tests ask whether it could be uniform noise:
chi-squared over bins of the alphabet, the number of runs above and below the middle, and
the correlation of neighbours. Strings of letters alone look more like words, so a fourth
test asks whether their letters are the common ones. The smallest p-value, corrected for the number
of tests, is uniform for noise and near zero for text.

False discoveries are controlled by strata of encoding and length, as a test says little
about a short string: the p-values above 0.5, which text does not reach, show how many
strings of noise each bin holds. A bin is given up only where bins from it on hold
significantly more than that and ``FALSE_SHARE`` of the accepted, so that chance alone
costs a stratum of noise at most ``LOST_SHARE`` of its strings, on average, at any number
of them. Strata of few strings are pooled over length, and without evidence their lowest
bin, where nearly all text is, stays out. Strings are counted once however often they
occur, over all documents; the table has a few hundred rows at any size.

Spans are half-open, in code points, sorted by start and then kind. Defined results: a
null or empty text has no spans. Input columns named ``spans`` are replaced.
"""

from __future__ import annotations

import math
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import fields_of, small_batches

KINDS = ("assign", "access", "hex", "random")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: What is tested of a token: the parts that one kind of separator or any leaves.
PARTS = (re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"))
LEAST = 20
SEPARATOR, LETTER = re.compile(r"[+/_-]"), re.compile(r"[A-Za-z]")
#: Encodings from the narrowest alphabet; the first that fits is inferred.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "letters64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "letters64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
CODES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
#: Encodings without digits, and about how often European languages use the letters a-z.
WORDLIKE = ("lower", "upper", "letters", "letters64", "letters64url")
COMMON = (8, 1.6, 3.4, 4.2, 15, 1.4, 2, 3.2, 7.4, 0.3, 0.6, 4.5, 2.6, 8, 6.2, 2.4, 0.6, 6.8, 7, 7.2, 4.2, 1.4, 1, 0.3, 1, 0.7)
SCORES = {c: math.log(f) for c, f in zip("abcdefghijklmnopqrstuvwxyz", COMMON)}
SCORE_MEAN = sum(SCORES.values()) / 26
SCORE_VARIANCE = sum((s - SCORE_MEAN) ** 2 for s in SCORES.values()) / 26
FALSE_SHARE = 0.01
#: Level of the test for text in a stratum, and bound of the noise that chance may cost:
#: the lowest bin (0.02), and with this probability up to 0.48 more.
LOST_SHARE = 0.05
BINS = 50
#: Runs of bins that are looked at for text, from the one in question on.
RUNS = (1, 2, 5, BINS // 2)
#: A stratum of fewer strings is pooled.
FEW = 100
#: Lower ends of the length strata.
LENGTHS = (20, 24, 32, 40, 64, 128, 256)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def encoding_of(token: str) -> str | None:
    for name, codes in CODES.items():
        if all(c in codes for c in token):
            return name
    return None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi_squared_p(codes: list[int], size: int) -> float:
    """Uniformity over bins of neighbouring symbols with five expected in each, by the
    cube-root approximation of the chi-squared tail."""
    n = len(codes)
    bins = max(2, min(size, n // 5))
    counts = [0] * bins
    for c in codes:
        counts[c * bins // size] += 1
    width = [0] * bins
    for c in range(size):
        width[c * bins // size] += 1
    chi = sum((o - n * w / size) ** 2 / (n * w / size) for o, w in zip(counts, width))
    df = bins - 1
    spread = 2.0 / (9.0 * df)
    return _normal_tail(((chi / df) ** (1 / 3) - (1.0 - spread)) / math.sqrt(spread))


def runs_p(codes: list[int], size: int) -> float:
    """Number of runs above and below the middle of the alphabet, two-sided."""
    high = [2 * c >= size for c in codes]
    n, above = len(high), sum(high)
    below = n - above
    if not above or not below:
        return 0.0
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2.0 * above * below / n + 1.0
    variance = (mean - 1.0) * (mean - 2.0) / (n - 1)
    return 2.0 * _normal_tail(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_p(codes: list[int]) -> float:
    """Correlation of neighbouring symbols, two-sided."""
    n = len(codes)
    mean = sum(codes) / n
    square = sum((c - mean) ** 2 for c in codes)
    if not square:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / square
    return 2.0 * _normal_tail(abs(r) * math.sqrt(n))


def letters_p(token: str) -> float:
    """Sum of the scores of the letters; common letters are unlike noise."""
    scores = [SCORES[c] - SCORE_MEAN for c in token.lower() if c in SCORES]
    return _normal_tail(sum(scores) / math.sqrt(SCORE_VARIANCE * len(scores))) if scores else 0.0


def noise_p(token: str, encoding: str) -> float:
    """p-value of the token under uniform noise in its encoding, over its tests."""
    codes = [CODES[encoding][c] for c in token]
    size = len(ALPHABETS[encoding])
    tests = [chi_squared_p(codes, size), runs_p(codes, size), serial_p(codes)]
    if encoding in WORDLIKE:
        tests.append(letters_p(token))
    return 1.0 - (1.0 - min(*tests, 1.0)) ** len(tests)


def stratum(length: int) -> int:
    return max(low for low in LENGTHS if low <= length)


def _uncovered(start: int, end: int, base: list[Span]) -> list[tuple[int, int]]:
    """The parts of ``start:end`` that no base span covers."""
    left, at = [], start
    for a, b in sorted((a, b) for _, a, b in base if a < end and start < b):
        if a > at:
            left.append((at, a))
        at = max(at, b)
    return [*left, (at, end)] if at < end else left


def candidates(text: str, base: list[Span] | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p) of the strings that are tested. A span is tested once;
    of what base spans leave, separators at the ends are no part."""
    base = base_spans(text) if base is None else base
    found = []
    for m in CANDIDATE.finditer(text):
        pieces = _uncovered(m.start(), m.end(), base)
        places = {m.span(): None} if pieces else {}
        for a, b in pieces:
            if b - a < LEAST:
                continue
            piece = text[a:b]
            if (a, b) != m.span():
                inner = piece.strip("+/_-")
                a += len(piece) - len(piece.lstrip("+/_-"))
                places[a, a + len(inner)] = None
            if SEPARATOR.search(piece):
                places |= {p.span(): None for form in PARTS for p in form.finditer(text, a, b)}
        for a, b in places:
            token = text[a:b]
            encoding = encoding_of(token) if b - a >= LEAST and LETTER.search(token) else None
            if encoding:
                found.append((a, b, encoding, noise_p(token, encoding)))
    return found


def thresholds(docs: DataFrame, text_column: str = "text", share: float = FALSE_SHARE) -> dict[tuple[str, int], float]:
    """The least accepted p-value of each (encoding, length stratum), from all documents."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = {(t[a:b], e, p) for t in batch.column("text").to_pylist() if t for a, b, e, p in candidates(t)}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([blake2b(c[0].encode(), digest_size=16).digest() for c in found], pa.binary()),
                    pa.array([c[1] for c in found], pa.string()),
                    pa.array([stratum(len(c[0])) for c in found], pa.int32()),
                    pa.array([min(int(c[2] * BINS), BINS - 1) for c in found], pa.int32()),
                ],
                names=["mark", "encoding", "stratum", "bin"],
            )

    columns = "mark binary, encoding string, stratum int, bin int"
    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(run, columns).distinct()
    counts: dict[tuple[str, int], list[int]] = {}
    for r in rows.groupBy("encoding", "stratum", "bin").count().collect():
        counts.setdefault((r["encoding"], r["stratum"]), [0] * BINS)[r["bin"]] = r["count"]
    return {key: threshold(pool, share) for keys, pool in pooled(counts) for key in keys}


def pooled(counts: dict[tuple[str, int], list[int]]) -> list[tuple[list[tuple[str, int]], list[int]]]:
    """Strata with their counts; neighbours in length of the same encoding are put
    together where each holds fewer than ``FEW`` strings."""
    pools: list[tuple[list[tuple[str, int]], list[int]]] = []
    for key in sorted(counts):
        if pools and pools[-1][0][0][0] == key[0] and max(sum(pools[-1][1]), sum(counts[key])) < FEW:
            keys, pool = pools.pop()
            pools.append(([*keys, key], [a + b for a, b in zip(pool, counts[key])]))
        else:
            pools.append(([key], counts[key]))
    return pools


def _binomial_tail(n: int, k: int, q: float) -> float:
    """Probability of ``k`` or more of ``n``."""
    if k <= 0:
        return 1.0
    if n > 2000:
        return _normal_tail((k - 0.5 - n * q) / math.sqrt(n * q * (1.0 - q)))
    return math.fsum(
        math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log1p(-q))
        for i in range(k, n + 1)
    )


def threshold(counts: list[int], share: float = FALSE_SHARE) -> float:
    """The least bin edge, at most 0.5, from which on no run of bins holds significantly
    more strings than noise and ``share`` of the accepted account for. Fewer than ``FEW``
    strings can not speak for their lowest bin, so it is left out."""
    half = BINS // 2
    high = sum(counts[half:])
    for low in range(0 if sum(counts) >= FEW else 1, half):
        allowed = int(share * sum(counts[low:]))
        runs = sorted({min(r, half - low) for r in RUNS})
        seen = [sum(counts[low : low + r]) - allowed for r in runs]
        if all(_binomial_tail(k + high, k, r / (r + half)) * len(runs) > LOST_SHARE for r, k in zip(runs, seen)):
            return low / BINS
    return 0.5


def all_spans(text: str, accepted: dict[tuple[str, int], float]) -> list[Span]:
    """Base spans, and accepted random strings that lie in no longer one. A random string
    may overlap a base span that covers a part of it."""
    base = base_spans(text)
    extra: list[Span] = []
    fit = [(a, b) for a, b, encoding, p in candidates(text, base) if p >= accepted.get((encoding, stratum(b - a)), 0.5)]
    for a, b in sorted(fit, key=lambda s: (s[0], -s[1])):
        if not extra or b > extra[-1][2]:
            extra.append(("random", a, b))
    return sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``spans``: array of (kind, start, end)."""
    accepted = thresholds(docs, text_column)
    kept = [c for c in docs.columns if c.lower() != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t or "", accepted)]
                for t in batch.column(text_column).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, kind)], names=[*kept, "spans"])

    spans = "spans array<struct<kind: string, start: int, end: int>>"
    return docs.select(*kept).mapInArrow(run, f"{fields_of(docs, *kept)}, {spans}")


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span of a secret replaced by ``mark``; overlapping spans
    become one mark. Other text stays as it is."""
    found = find_secrets(docs, text_column)

    def step(state, span):
        begin = F.greatest(state["at"], span["start"] + 1)
        between = F.substring(text_column, state["at"], F.greatest(begin - state["at"], F.lit(0)))
        fresh = span["start"] + 1 >= state["at"]
        return F.struct(
            F.concat(state["text"], F.when(fresh, F.concat(between, F.lit(mark))).otherwise("")).alias("text"),
            F.greatest(state["at"], span["end"] + 1).alias("at"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    whole = F.col(text_column)
    rest = F.aggregate("spans", start, step, lambda s: F.concat(s["text"], whole.substr(s["at"], F.length(whole))))
    return found.withColumn(text_column, F.when(F.size("spans") > 0, rest).otherwise(F.col(text_column))).drop("spans")
