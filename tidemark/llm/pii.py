"""Operator 5: personal data by exact rules and a semi-Markov conditional random field.

The rules find the four base kinds; their spans always stay. The field adds what rules miss: it segments each region
around a trigger (digits, groups of hexadecimal digits between colons, an at sign or its word in brackets, a long run of letters and digits) into single tokens outside and whole spans of a
kind, of at most ``MOST_TOKENS`` tokens and ``MOST_CHARS`` characters. A span has an at sign or its word, a token of 20
characters or more, two colons, or 7 to 34 digits. Features score whole candidate spans (shape, length, check digits, the words before it), and a
dynamic programme over bounded segments picks boundaries and kinds jointly; a kind has a cost for each kind that it follows at once. A region around an at sign or such a word takes in all
tokens that a span of ``MOST_TOKENS`` may have beside it; around digits and long runs it ends with them, so words of letters that are more than
three characters from any trigger are not candidates, and the optimum is that of the regions. Base spans are barriers. The weights maximise the penalised
likelihood of lines made from templates with a fixed seed, and are fitted anew in each process that asks for them.

Texts of any length take time and memory in proportion: tokens are read in blocks of ``BLOCK_TOKENS`` with the few before
that a span may begin in. As such costs never add to a score, a segment whose best score is not positive never beats leaving its tokens
outside, so only the others are kept, until none that is still to come can overlap them; then their optimum is final.

A null text is empty and has no spans. Rows of equal or null doc_id are read each on its own; other columns are left out
of ``find`` and pass through ``mask``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
import string
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: In the order in which spans are listed. The field adds spans of any kind.
KINDS = ("email", "ip", "card", "phone", "secret", "id_number")
BASE = KINDS[:4]
MOST_TOKENS, MOST_CHARS = 16, 512
#: Tokens that are scored together, and characters of short texts that are.
BLOCK_TOKENS, BATCH_CHARS = 4096, 200_000

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits that does not begin a match has no later place that does, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
#: Possessive, so that a match as long as the text takes no memory; a lone digit is no card either way.
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches around each at sign, in time linear in the text."""
    begin, at = 0, text.find("@")
    while at >= 0:
        before = text[begin:at]
        local = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        begin = found.end() if found else at + 1
        at = text.find("@", begin)


def digits_in(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Of the four base kinds, by kind and start."""
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 13 <= len(m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits_in(m[0])):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_in(m[0])) <= 15]
    return found


# The field.

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
WORD = re.compile(r"[^\W_]*")
TRIGGER = re.compile(r"\b[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}\b|\b[A-Z]{2}[0-9]{2} [A-Z]{4}(?= [0-9])|[0-9]+|@|[A-Za-z0-9]{20,}|\b(?i:at|dot)\b(?= ?[\])}])")
#: What keys begin with.
PREFIX = re.compile(r"(?<![^\W_])(?:[A-Za-z]{2,5}[_-]){1,2}\Z")
#: Words that introduce a kind, as they are matched in lower case just before a span.
CUES = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server", "from", "peer"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell"),
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "bearer", "credential"),
    "id_number": ("ssn", "social", "security", "passport", "insurance", "id", "iban", "account"),
}
#: Words that introduce numbers and codes which are nobody's.
OTHER_CUES = frozenset("commit sha md5 hash digest checksum etag revision rev isbn issn doi uuid guid version build release order value measured lat lon coordinates parcel ticket invoice page".split())
SHAPES = (
    re.compile(r"(?:\+[0-9]{1,3} )?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
    re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    re.compile(r"[A-Za-z0-9_.-]+ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]+(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z]+|\.[A-Za-z]+)+", re.I),
    re.compile(r"[0-9a-fA-F]{24,}"),
    re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9]{20,}"),
    re.compile(r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}"),
    re.compile(r"[0-9]+(?:[.,][0-9]+)*"),
    re.compile(r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"),
    re.compile(r"[0-9]{4}([./_])[0-9]{4}(?:\1[0-9]{4}){2}"),  # a card with other separators
    re.compile(r"[0-9]+[.,][0-9]{3,}"),
    re.compile(r"(?:\+[0-9]{1,3} )?\([0-9]{2,5}\) ?[0-9]{3}(?:[0-9]{2,5}|-[0-9]{4})"),  # an area code in brackets
    re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?!.*::.*::)[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,7}"),
    re.compile(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}"),
    re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?"),  # an account number
    re.compile(r"[A-Za-z]{2,5}[_-](?:[A-Za-z]{2,5}_)?[A-Za-z0-9]{20,}"),  # a key with a prefix
    re.compile(r"(?=.*[0-9])[A-Z]{4}[A-Z0-9]{16}"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]{3}-[0-9]{1,5}-[0-9]{1,7}-[0-9]{1,7}-[0-9]"),
    re.compile(r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?|[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|X)?"),
    re.compile(r"[0-9]{2}(?:[ .-][0-9]{2}){4}|[0-9]{2,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}|[0-9]{4,5}[ /-][0-9]{4,8}|[0-9]{5} [0-9]{6}|[0-9]{2}[0-9]{2} [0-9]{2} [0-9]{3,8}(?: [0-9]{3,5})?"),  # national numbers
)
#: Characters of a kind that span features do not tell apart, by what they become.
ALIKE = str.maketrans(string.digits + string.ascii_letters, "0" * 10 + "b" * 6 + "x" * 20 + "B" * 6 + "X" * 20)
ZEROS = str.maketrans(string.digits, "0" * 10)


def span_features(span: str) -> list[float]:
    """Of the span's own characters."""
    n_digits, inner = len(DIGIT.findall(span)), len(TOKEN.findall(span))
    return [
        1.0,
        *[float(bool(s.fullmatch(span))) for s in SHAPES],
        math.log1p(len(span)) / 4,
        n_digits / len(span),
        float(n_digits == 9),
        float(n_digits in (7, 10, 11)),
        float("@" in span),
        float("," in span),
        float(inner == 1),
        inner / MOST_TOKENS,
        float(n_digits > 19),
        float(":" in span),
        float("." in span),
        float(" " in span),
    ]


def start_features(upto: str) -> list[float]:
    """Of up to 24 characters before the span and its first."""
    before, first = upto[:-1], upto[-1:]
    cue, left = set(re.findall(r"[a-z]+", before.lower())[-2:]), before[-1:]
    return [
        *[float(bool(cue.intersection(CUES[k]))) for k in KINDS],
        float(not cue.isdisjoint(OTHER_CUES)),
        float(left.isalnum() or left in "-_+/" and left != ""),
        float(left in ".,-:" and left != "" and before[-2:-1].isalnum()),
        float(left in " -" and left != "" and before[-2:-1].isdigit() and first.isdigit()),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
    ]


def end_features(after: str) -> list[float]:
    """Of the two characters after the span."""
    right = after[:1]
    return [
        float(right.isalnum() or right in "-_/@" and right != ""),
        float(right in ".,:" and right != "" and after[1:].isalnum()),
        float(right in " -" and right != "" and after[1:].isdigit()),
    ]


N_SPAN, N_START, N_END = len(SHAPES) + 13, len(KINDS) + 5, 3
#: The last: a card's check digits, the same quote on either side, and a zero as the first digit.
N_JOINT = 3
N_FEATURES = N_SPAN + N_START + N_END + N_JOINT


def _beside(text: str, start: int, end: int) -> tuple[int, int]:
    """From the ``MOST_TOKENS`` - 1 tokens before ``start`` to those after ``end``."""
    reach = 64
    while True:  # a window's first token may be a part of one, unless the text begins there
        low = max(0, start - reach)
        before = [m.start() for m in TOKEN.finditer(text, low, start)][0 if low == 0 else 1 :]
        if low == 0 or len(before) >= MOST_TOKENS - 1:
            break
        reach *= 2
    last = end
    for _, m in zip(range(MOST_TOKENS - 1), TOKEN.finditer(text, end), strict=False):
        last = m.end()
    return before[-(MOST_TOKENS - 1) :][0] if before else start, last


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers, near ones joined; only these are searched. Linear in the text."""
    starts, ends, word_end = array("q"), array("q"), 0
    for m in TRIGGER.finditer(text):
        start, end = m.span()
        if end <= word_end:
            continue
        if m[0].lower() in ("@", "at", "dot"):
            start, end = _beside(text, start, end)
        else:  # the whole run of letters and digits
            while start > word_end and text[start - 1].isalnum():
                start -= 1
            end = word_end = WORD.match(text, end).end()
            if end - start >= 20 and (prefix := PREFIX.search(text, max(0, start - 12), start)):
                start = prefix.start()
        if start and text[start - 1] in "(+":
            start -= 1
        while ends and start - ends[-1] <= 3:
            start, end = min(start, starts.pop()), max(end, ends.pop())
        starts.append(start), ends.append(end)
    return zip(starts, ends, strict=True)


class Lattice:
    """The candidate segments of a block of tokens, with what their features are looked up by.

    tokens: (start, end, whether a segment may not go on from the token before), by place; ``old`` of them were in the block before.
    """

    def __init__(self, text: str, block: list[tuple[int, int, bool]], old: int, barred=((), ())):
        import numpy as np

        self.text = text
        p, q, breaks = (np.array(x, np.int64) for x in zip(*block, strict=True))
        words = [text[a:b] for a, b, _ in block]
        runs = ["".join(DIGIT.findall(w)) if q - p <= MOST_CHARS else "0" * (q - p) for w, p, q in zip(words, p.tolist(), q.tolist(), strict=True)]
        digits = np.concatenate(([0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))))
        at = np.array([w == "@" or len(w) == 2 and w.lower() == "at" for w in words])
        since = lambda flags: np.concatenate(([0], np.cumsum(flags)))
        ats, longs, colons = since(at), since(q - p >= 20), since([w == ":" for w in words])
        low, high = barred
        place = np.searchsorted(high, p, side="right")
        free = np.ones(len(p), bool) if not len(low) else ~((place < len(low)) & (np.append(low, np.iinfo(np.int64).max)[place] < q))
        ends = [w[-1].isalnum() for w in words]
        opens = free & np.array([w[0].isalnum() or w[0] in "(+" for w in words])
        closes = free & np.array(ends)
        self.fresh = breaks.astype(bool)
        breaks = since(breaks.astype(bool) | ~free | np.concatenate(([False], ~free[:-1])))
        firsts, lasts = [], []
        for length in range(1, min(MOST_TOKENS, len(p)) + 1):
            i = np.arange(max(0, old - length + 1), len(p) - length + 1)
            j = i + length
            n, chars = digits[j] - digits[i], q[j - 1] - p[i]
            marked = (ats[j] > ats[i]) | (longs[j] > longs[i]) | (colons[j] > colons[i] + 1) | (n >= 7) & (n <= 34)
            ok = opens[i] & closes[j - 1] & (breaks[j] == breaks[i + 1]) & marked & (chars >= 6) & (chars <= MOST_CHARS)
            firsts.append(i[ok]), lasts.append(j[ok])
        self.i, self.j = np.concatenate(firsts), np.concatenate(lasts)
        self.begin, self.end = p[self.i], q[self.j - 1]
        self.fresh = self.fresh[self.i]  # no segment ends just before it in the same line and region
        self.exact = ats[self.j] > ats[self.i]
        value = np.frombuffer("".join(runs).encode(), np.uint8).astype(np.int64) - 48
        self.luhn = self._luhn(value, digits[self.i], digits[self.j]) & (digits[self.j] - digits[self.i] >= self.end - self.begin - 4)

    @staticmethod
    def _luhn(value, low, high):
        """Do the digits from ``low`` to ``high`` pass, and are they 13 to 19."""
        import numpy as np

        even = np.arange(len(value)) % 2 == 0
        doubled = 2 * value - 9 * (value > 4)
        since = lambda x: np.concatenate(([0], np.cumsum(x)))
        ending_even, ending_odd = since(np.where(even, value, doubled)), since(np.where(even, doubled, value))
        total = np.where((high - 1) % 2 == 0, ending_even[high] - ending_even[low], ending_odd[high] - ending_odd[low])
        return (total % 10 == 0) & (high - low >= 13) & (high - low <= 19)

    def keys(self):
        """(span, before with the first character, after, joint features) of each segment; characters that a feature does not tell apart are as one."""
        import numpy as np

        text = self.text
        begins, ends = self.begin.tolist(), self.end.tolist()
        spans = [text[a:b] if exact else text[a:b].translate(ALIKE) for a, b, exact in zip(begins, ends, self.exact.tolist(), strict=True)]
        before = [text[max(0, a - 24) : a + 1].translate(ZEROS) for a in begins]
        after = [text[b : b + 2].translate(ZEROS) for b in ends]
        quoted = np.array([x[-2:-1] in ("'", '"') and x[-2:-1] == y[:1] for x, y in zip(before, after, strict=True)], bool)
        zero = np.array([text[a] == "0" or text[a : a + 2] == "(0" for a in begins], bool)
        return spans, before, after, np.column_stack([self.luhn, quoted, zero]).astype(float)


def feature_matrix(lattice: Lattice):
    """The features of each segment."""
    import numpy as np

    spans, before, after, joint = lattice.keys()
    rows = [span_features(s) + start_features(b) + end_features(a) for s, b, a in zip(spans, before, after, strict=True)]
    return np.column_stack([np.array(rows).reshape(len(rows), N_FEATURES - N_JOINT), joint])


class Scorer:
    """Scores of segments by kind. What recurs (shapes of spans, what stands before and after) is scored once; bounded by starting anew."""

    def __init__(self, weights, most: int = 20_000):
        cuts = (0, N_SPAN, N_SPAN + N_START, N_FEATURES - N_JOINT)
        self.parts = [(f, weights[a:b], {}) for f, a, b in zip((span_features, start_features, end_features), cuts, cuts[1:], strict=False)]
        self.joint, self.moves, self.most = weights[N_FEATURES - N_JOINT : N_FEATURES], weights[N_FEATURES:], most

    def __call__(self, lattice: Lattice):
        import numpy as np

        *keys, joint = lattice.keys()
        total = joint @ self.joint
        for (features, weights, known), own in zip(self.parts, keys, strict=True):
            if len(known) > self.most:
                known.clear()
            for key in set(own).difference(known):
                known[key] = np.array(features(key)) @ weights
            total += np.array([known[k] for k in own])
        return total


def token_blocks(text: str, parts, old: int = MOST_TOKENS - 1) -> Iterator[tuple[list[tuple[int, int, bool]], int, int]]:
    """(tokens, how many of them were in the block before, place of the first) of the regions ``parts``."""
    block, kept, first = [], 0, 0
    for begin, end in parts:
        last = None
        for m in TOKEN.finditer(text, begin, end):
            p, q = m.span()
            block.append((p, q, last is None or "\n" in text[last:p]))
            last = q
            if len(block) - kept >= BLOCK_TOKENS:
                yield block, kept, first
                first, block = first + len(block) - old, block[-old:]
                kept = old
    if len(block) > kept:
        yield block, kept, first


def best_segments(n: int, segments: list[tuple[int, int]], scores, moves=None, fresh=None) -> list[tuple[int, int, int]]:
    """Segments (i, j, kind) of greatest total score; a token outside scores 0. A kind that follows another at once gets the
    weight ``moves`` [before, own], unless its segment is ``fresh``."""
    import numpy as np

    kinds = scores.shape[1] if len(segments) else 0
    moves = np.zeros((kinds, kinds)) if moves is None else moves
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j) in enumerate(segments):
        ending[j].append(s)
    value, back = np.full((n + 1, kinds + 1), -np.inf), {}  # by what ends there: a token outside (0) or a kind
    value[0, 0] = 0.0
    for j in range(1, n + 1):
        last = int(value[j - 1].argmax())
        value[j, 0], back[j, 0] = value[j - 1, last], (j - 1, last)
        for s in ending[j]:
            i = segments[s][0]
            ways = value[i][:, None] + (0.0 if fresh is not None and fresh[s] else np.vstack([np.zeros(kinds), moves]))
            ways = np.broadcast_to(ways, (kinds + 1, kinds)) + scores[s]
            for kind, last in enumerate(ways.argmax(axis=0).tolist()):
                if ways[last, kind] > value[j, kind + 1]:
                    value[j, kind + 1], back[j, kind + 1] = ways[last, kind], (i, last)
    found, j, last = [], n, int(value[n].argmax())
    while j:
        i, before = back[j, last]
        if last:
            found.append((i, j, last - 1))
        j, last = i, before
    return found[::-1]


class Lines:
    """Lines as one batch: expected segments and moves by forward and backward sums over all segmentations of each line."""

    def __init__(self, cases):
        """cases: (tokens, segments, fresh) of each line."""
        import numpy as np

        self.count, self.most = len(cases), max(n for n, _, _ in cases)
        self.line = np.repeat(np.arange(len(cases)), [len(x) for _, x, _ in cases])
        self.i, self.j = (np.array([x[k] for _, segments, _ in cases for x in segments], np.int64) for k in (0, 1))
        self.joined = ~np.concatenate([np.asarray(f, bool) for _, _, f in cases])
        self.by_start, self.by_end = (self._steps(of) for of in (self.i, self.j))

    def _steps(self, of):
        """For each place its segments, by line, and where a line's begin."""
        import numpy as np

        found = []
        for place in range(self.most + 1):
            own = np.flatnonzero(of == place)
            own = own[np.argsort(self.line[own], kind="stable")]
            lines, starts = np.unique(self.line[own], return_index=True)
            found.append((own, lines, starts))
        return found

    def expected(self, scores, moves):
        """(log partition function of each line, probability of each segment and kind, expected moves of kind to kind)."""
        import numpy as np

        pool = np.logaddexp.reduce
        kinds = scores.shape[1]
        ahead = np.full((self.count, self.most + 1, kinds + 1), -np.inf)
        behind = np.zeros((self.count, self.most + 1, kinds + 1))
        ahead[:, 0, 0] = 0
        into = np.empty((len(self.i), kinds))  # all that may stand before a segment of a kind
        for j in range(1, self.most + 1):
            ahead[:, j, 0] = pool(ahead[:, j - 1], axis=1)
            own, lines, starts = self.by_end[j]
            if len(own):
                before = ahead[self.line[own], self.i[own]]
                after_kind = pool(before[:, 1:, None] + np.where(self.joined[own], 1.0, 0.0)[:, None, None] * moves, axis=1)
                into[own] = np.logaddexp(before[:, :1], after_kind)
                ahead[lines, j, 1:] = np.logaddexp.reduceat(into[own] + scores[own], starts, axis=0)
        for i in range(self.most - 1, -1, -1):
            behind[:, i] = behind[:, i + 1, :1]
            own, lines, starts = self.by_start[i]
            if len(own):
                ways = scores[own] + behind[self.line[own], self.j[own], 1:]
                after_kind = pool(ways[:, None, :] + np.where(self.joined[own], 1.0, 0.0)[:, None, None] * moves, axis=2)
                total = np.column_stack([pool(ways, axis=1), after_kind])
                behind[lines, i] = np.logaddexp(behind[lines, i], np.logaddexp.reduceat(total, starts, axis=0))
        whole = pool(ahead[:, -1], axis=1)
        rest = scores + behind[self.line, self.j, 1:] - whole[self.line, None]
        own = self.joined
        pairs = ahead[self.line[own], self.i[own], 1:, None] + moves + rest[own][:, None, :]
        return whole, np.exp(into + rest), np.exp(pairs).sum(axis=0)


def training_lines(n: int = 700, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made lines with their spans, and lines whose numbers are nobody's."""
    rng = random.Random(seed)
    HEX = "0123456789abcdef"  # noqa: N806
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9)))
    num = lambda k: "".join(rng.choices(string.digits, k=k))
    letters = lambda k, of: "".join(rng.choices(of, k=k))

    def card(k=16):
        body = num(k - 1)
        return next(body + d for d in string.digits if luhn(body + d))

    def v6():
        groups = [f"{rng.randrange(1 << rng.choice([4, 8, 16, 16, 16])):x}" for _ in range(8)]
        if rng.random() < 0.5:
            at = rng.randint(1, 5)
            return ":".join(groups[:at]) + "::" + ":".join(groups[at + rng.randint(1, 7 - at) :])
        return ":".join(g.zfill(4) for g in groups) if rng.random() < 0.5 else ":".join(groups)

    def national():
        """Made to the length of the numbers of several countries."""
        first = lambda k: rng.choice("123456789") + num(k - 1)
        german, french = "0" + first(rng.choice([2, 3, 4])), ["0" + first(1), num(2), num(2), num(2), num(2)]
        return [f"{german}{rng.choice([' ', '/', '-', ' / '])}{first(rng.randint(6, 8))}", f"({german}) {first(rng.randint(5, 7))}", f"{german} {num(3)} {num(4)}", " ".join(french), rng.choice(["-", ""]).join(french), f"0{first(2)} {num(4)} {num(4)}", f"0{first(4)} {num(6)}", f"00{num(2)} {first(2)} {num(3)} {num(4)}"]

    def keys():
        mixed = string.ascii_letters + string.digits
        return [f"{rng.choice(['ghp', 'gho', 'glpat', 'xoxb'])}{rng.choice('_-')}{letters(36, mixed)}", f"AKIA{letters(16, string.ascii_uppercase + string.digits)}", f"{rng.choice(['sk', 'pk'])}{rng.choice(['_live_', '_test_', '-'])}{letters(rng.randint(24, 40), mixed)}"]

    def account():
        return rng.choice([f"DE{num(20)}", f"FR{num(25)}", f"GB{num(2)}{letters(4, string.ascii_uppercase)}{num(14)}", f"NL{num(2)}{letters(4, string.ascii_uppercase)}{num(10)}", f"ES{num(22)}", f"IT{num(2)}{letters(1, string.ascii_uppercase)}{num(22)}"])

    makes = {
        "email": lambda: rng.choice([f"{word()}.{num(2)} [at] {word()} [dot] com", f"{word()}(at){word()}.org", f"{word()} {{at}} {word()} {{dot}} net", f"{word()}{num(1)}[at]{word()}[dot]{word()}[dot]de"]),
        "ip": lambda: rng.choice([v6(), v6(), v6(), ".".join(str(rng.randint(0, 255)) for _ in range(4))]),
        "card": lambda: rng.choice([card(), " ".join(re.findall("....", card())), rng.choice("./_").join(re.findall("....", card()))]),
        "phone": lambda: rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", *national()]),
        "secret": lambda: rng.choice([letters(40, HEX), letters(32, HEX), letters(64, HEX), letters(24, string.ascii_letters) + num(6) + letters(6, string.ascii_letters), *keys(), *keys()]),
        "id_number": lambda: rng.choice([f"{num(3)}-{num(2)}-{num(4)}", account(), " ".join(re.findall(".{1,4}", account()))]),
    }
    code = lambda k: letters(k, HEX)
    day = lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(10, 28)}"
    clock = lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}"
    others = (
        day, lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: num(rng.randint(1, 12)), lambda: num(16), lambda: num(rng.randint(7, 11)),
        lambda: f"{num(2)}.{num(2)} EUR", lambda: f"{num(3)}-{num(3)}", lambda: word() + num(2), lambda: f"page {num(3)} of {num(4)}", lambda: f"{num(10)}-{num(12)}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: letters(rng.randint(20, 45), string.ascii_lowercase), lambda: " | ".join(num(4) for _ in range(5)), lambda: f"sha1 {num(12)}", lambda: f"{num(4)} {num(4)}",
        lambda: " ".join(num(rng.randint(1, 6)) for _ in range(rng.randint(5, 30))), lambda: " ".join(num(rng.randint(1, 8)) for _ in range(rng.randint(5, 20))), lambda: " ".join(num(rng.randint(2, 7)) for _ in range(rng.randint(3, 6))),
        *[lambda: " ".join(num(rng.randint(1, 7)) for _ in range(rng.randint(6, 16)))] * 4, lambda: ", ".join(num(rng.randint(2, 5)) for _ in range(rng.randint(4, 12))),
        lambda: f"{num(rng.randint(1, 4))}.{num(rng.randint(2, 12))}", lambda: f"{rng.choice(['', '-'])}{num(2)}.{num(rng.randint(4, 7))}, {rng.choice(['', '-'])}{num(rng.randint(1, 3))}.{num(rng.randint(4, 7))}",
        lambda: f"0.{num(rng.randint(4, 10))} {num(1)}.{num(rng.randint(3, 8))}", lambda: f"{num(1)}.{num(5)}e-{num(2)}", lambda: f"{num(1)}.{num(3)}.{num(3)},{num(2)}", lambda: f"{num(1)} {num(3)} {num(3)}",
        lambda: f"v{num(1)}.{num(2)}.{num(1)}-rc{num(1)}", lambda: f"{num(2)}.{num(1)}.{num(4)}.{num(5)}", lambda: f"{day()}T{clock()}:{num(2)}Z", lambda: f"{day()} {clock()}:{num(2)}.{num(3)}", lambda: f"{clock()} to {clock()}",
        lambda: f"{clock()}:{num(2)} {clock()}:{num(2)}", lambda: f"{code(8)}-{code(4)}-{code(4)}-{code(4)}-{code(12)}", lambda: f"{rng.choice(['', 'ISBN '])}97{rng.choice('89')}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"ISBN {num(10)}",
        lambda: f"{rng.choice(['commit', 'sha256', 'md5', 'sha1', 'etag', 'hash', 'checksum'])}{rng.choice([' ', ': ', ':', '=', ' is '])}{code(rng.choice([32, 40, 40, 64, 64]))}", lambda: f"ISSN {num(4)}-{num(4)}", lambda: f"10.{num(4)}/{word()}.{num(4)}.{num(6)}",
        lambda: ":".join(code(2) for _ in range(6)), lambda: f"{num(4)}-{num(4)}", lambda: f"order {num(4)}-{num(6)}", lambda: f"no. {num(2)}-{num(3)}-{num(3)}", lambda: f"{num(1)}:{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)} {clock()}",
        lambda: f"std::{word()}::{word()}", lambda: f"{num(5)} {num(5)}", lambda: f"{num(3)}x{num(3)}x{num(4)}", lambda: f"{word()}{letters(20, string.ascii_lowercase)}", lambda: f"http://{word()}.org/{num(8)}/{word()}-{num(6)}",
    )
    lines = []
    for i in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.55:
                kind = KINDS[i % len(KINDS)] if rng.random() < 0.7 else rng.choice(KINDS)
                made = makes[kind]()
                bare = kind == "secret" and (made.isalnum() and not made.startswith("AKIA"))  # nothing but what stands before tells what it is
                if bare or rng.random() < 0.4:
                    text += rng.choice(CUES[kind]) + (rng.choice([' = "', ": ", "=", ' "', " "]) if kind == "secret" else rng.choice([" ", ": "]))
                while True:  # now and then the next one follows at once
                    spans.append((kind, len(text), len(text) + len(made)))
                    text += made
                    if kind not in BASE[1:] or rng.random() < 0.7:
                        break
                    text, kind = text + " ", rng.choice(BASE[1:])
                    made = makes[kind]()
                text += rng.choice(['"' if text[spans[-1][1] - 1] == '"' else "", ""]) + rng.choice([" ", ". ", ", "])
            else:
                text += rng.choice(others)() + rng.choice([" ", ". ", ", "])
        lines.append((text, spans))
    return lines


@functools.lru_cache(maxsize=1)
def fitted(rounds: int = 80, penalty: float = 0.02):
    """Weights (feature by kind, then kind before by kind) by gradient ascent with per-weight steps on the penalised log-likelihood.

    What the rules find is a barrier in training too, so the field learns what is left to it."""
    import numpy as np

    cases, features, truths, chain = [], [], [], np.zeros((len(KINDS), len(KINDS)))
    for text, spans in training_lines():
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        barred = tuple(np.array([x[k] for x in taken], np.int64) for k in (0, 1))
        for block, old, _ in token_blocks(text, regions(text)):
            lattice = Lattice(text, block, old, barred)
            if not len(lattice.i):
                continue
            truth = np.zeros((len(lattice.i), len(KINDS)))
            at = {(a, b): s for s, (a, b) in enumerate(zip(lattice.begin.tolist(), lattice.end.tolist(), strict=True))}
            ends = {}
            for kind, a, b in spans:
                if (s := at.get((a, b))) is not None:
                    truth[s, KINDS.index(kind)] = 1
                    if not lattice.fresh[s] and int(lattice.i[s]) in ends:
                        chain[ends[int(lattice.i[s])], KINDS.index(kind)] += 1
                    ends[int(lattice.j[s])] = KINDS.index(kind)
            cases.append((len(block), list(zip(lattice.i.tolist(), lattice.j.tolist(), strict=True)), lattice.fresh))
            features.append(feature_matrix(lattice)), truths.append(truth)
    lines, x, truth = Lines(cases), np.concatenate(features), np.concatenate(truths)
    weights = np.zeros((N_FEATURES + len(KINDS), len(KINDS)))
    weights[0] = -2.0
    squares = np.full_like(weights, 1e-3)
    for _ in range(rounds):
        _, found, moved = lines.expected(x @ weights[:N_FEATURES], weights[N_FEATURES:])
        gradient = np.concatenate([x.T @ (truth - found), chain - moved]) - penalty * weights
        squares += gradient**2
        weights = weights + 0.5 * gradient / np.sqrt(squares)
        weights[N_FEATURES:] = np.minimum(weights[N_FEATURES:], 0)  # so that a segment of no gain by itself can be left out at once
    return weights


def added_spans(text: str, parts, barred, scorer: Scorer) -> Iterator[tuple[str, int, int]]:
    """What the field finds in the regions ``parts``, in order; ``barred``: starts and ends of disjoint stretches, as two arrays."""
    import numpy as np

    held: list[tuple] = []  # segments (i, j, begin, end, scores, fresh) that later ones may overlap

    def settled():
        low = min(h[0] for h in held)
        chosen = best_segments(max(h[1] for h in held) - low, [(h[0] - low, h[1] - low) for h in held], np.array([h[4] for h in held]), scorer.moves, [h[5] for h in held])
        places = {(h[0] - low, h[1] - low): h[2:4] for h in held}
        return [(KINDS[kind], *places[i, j]) for i, j, kind in chosen]

    reach = 0
    for block, old, first in token_blocks(text, parts):
        lattice = Lattice(text, block, old, barred)
        if not len(lattice.i):
            continue
        scores = scorer(lattice)
        good = np.flatnonzero(scores.max(axis=1) > 0)
        for s in good[np.lexsort((lattice.i[good], lattice.j[good]))].tolist():
            i, j = first + int(lattice.i[s]), first + int(lattice.j[s])
            if held and j - MOST_TOKENS > reach:
                yield from settled()
                held.clear()
            held.append((i, j, int(lattice.begin[s]), int(lattice.end[s]), scores[s], bool(lattice.fresh[s])))
            reach = j
    if held:
        yield from settled()


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


#: Between texts that are searched as one: no span and no feature reaches over it.
BETWEEN = "\n" * 32


def spans_of_all(texts: list[str], scorer: Scorer) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    import numpy as np

    bases = [base_spans(t) for t in texts]
    starts = list(itertools.accumulate([0, *(len(t) + len(BETWEEN) for t in texts[:-1])]))
    low, high = [], []
    for start, base in zip(starts, bases, strict=True):
        for a, b in sorted((a, b) for _, a, b in base):
            if high and start + a <= high[-1]:
                high[-1] = max(high[-1], start + b)
            else:
                low.append(start + a), high.append(start + b)
    parts = ((start + a, start + b) for start, text in zip(starts, texts, strict=True) for a, b in regions(text))
    found = added_spans(texts[0] if len(texts) == 1 else BETWEEN.join(texts), parts, (np.array(low, np.int64), np.array(high, np.int64)), scorer)
    ahead = next(found, None)
    for start, text, base in zip(starts, texts, bases, strict=True):
        more = []
        while ahead is not None and ahead[1] < start + len(text):
            more.append((ahead[0], ahead[1] - start, ahead[2] - start))
            ahead = next(found, None)
        yield base, more


def spans_of(text: str, weights) -> tuple[list, list]:
    """(base spans, added spans)."""
    return next(spans_of_all([text], Scorer(weights)))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, how many the field added and how many there are."""
    weights = fitted()

    def run(batches):
        def rows():
            scorer = Scorer(weights)
            for part in tokens.in_batches(((i, t or "") for i, t in common.batch_rows(batches)), 1, BATCH_CHARS):
                for (doc_id, _), (base, more) in zip(part, spans_of_all([t for _, t in part], scorer), strict=True):
                    kinds = [k for k, _, _ in base]
                    yield doc_id, *[kinds.count(k) for k in BASE], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), len(base) + len(more)

        return common.record_batches(rows(), SCHEMA, 1024)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, overlapping ones as one, replaced by its kind in brackets."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text`` masked; null stays null, and no row is dropped."""
    weights = fitted()

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(weights)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                clean = []
                for rows in tokens.in_batches(((t, t or "") for t in part.column(at).to_pylist()), 1, BATCH_CHARS):
                    clean += [t if t is None else masked(t, base + more) for (t, _), (base, more) in zip(rows, spans_of_all([t for _, t in rows], scorer), strict=True)]
                yield part.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
