"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns find e-mail addresses, IPv4 addresses, payment cards and international phone numbers;
what they find stays.  Between those spans the random field proposes further ones (spelt-out
addresses, IPv6, national phone numbers, cards with other separators, secrets such as keys, signed
tokens and passwords that are named, social security and bank account numbers): features are read
off whole candidate segments and their surroundings, and a dynamic program over segments of at
most ``TOKENS`` tokens and, if of several, ``CHARS`` characters (a single token can be of any
length) chooses boundaries and types together.  A segment
needs a token with a digit, an at sign or a word for one, and starts and ends within ``REACH``
tokens of such a token.  All other tokens can only be outside, so running the program on the
islands around those tokens gives the best labelling of the whole text.

The weights are trained here, by conditional likelihood on sentences made from rules with a fixed
seed (``trained``).

Nulls: a null text is empty and has no spans; a null doc_id stays.  Repeated rows each get a row.
An empty table gives no rows.  Columns beyond doc_id and text aren't read by :func:`found`, and are
returned by :func:`redacted`.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")
TOKENS, CHARS, REACH = 8, 120, 3
Span = tuple[int, int, str]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> Iterator[Span]:
    """One candidate for each at sign, as a match holds exactly one; linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        local = text[end:at]
        start = end + len(local.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind as in BASE."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


# --- the random field ---------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]|^dot$", re.I)
_ANY_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]|\bdot\b", re.I)
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`()[]{}<>,.;:!?%#&*$=|~^«»“”"
_HEX, _LONG_KEY = re.compile(r"[0-9A-Fa-f]{20,}"), re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/\-]{20,}={0,2}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){2}")
_IPV6 = re.compile(r"(?=.*[0-9])(?=(?:.*:){2})[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_CLOCK = re.compile(r"[0-9]{1,2}(:[0-9]{2}){1,2}")
_DATE = re.compile(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{2,4}")
_SPELT = re.compile(r"[\w.+-]+ ?[(\[]at[)\]] ?[\w-]+(?: ?(?:[(\[]dot[)\]]|\.) ?[\w-]+)+|[\w.+-]+ at [\w-]+(?: dot [\w-]+)+", re.I)
_NATIONAL = re.compile(r"\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}|0[0-9]{1,4}(?:[ .-][0-9]{2,4}){2,4}")
_SSN, _IBAN = re.compile("[0-9]{3}-[0-9]{2}-[0-9]{4}"), re.compile("[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)")
_AWS, _DIGEST = re.compile("A[KS]IA[A-Z0-9]{16}"), re.compile(r"(?:sha-?[0-9]{1,3}|md5)[:=-][0-9A-Fa-f]+", re.I)
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[!-~]{6,}")
_UUID, _ASSIGNED = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"), re.compile(r"(?:password|passwd|pwd|secret|token|api_?key)[=:]\S{6,}", re.I)
#: Words that say that digits in base 16 are a digest, which isn't a secret.
_HASHED = {"commit", "sha", "sha1", "sha256", "sha512", "md5", "hash", "digest", "checksum", "revision", "rev", "merge", "tree", "blob", "git", "etag"}
_NEAR = {
    "phone": {"tel", "phone", "call", "mobile", "fax", "ring", "whatsapp", "telefon"},
    "secret": {"token", "key", "secret", "password", "apikey", "api_key", "passwd", "pwd", "bearer"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "ip": {"ip", "host", "address", "server"},
    "email": {"mail", "email", "e-mail", "contact", "write"},
    "id": {"ssn", "social", "iban", "account", "konto", "id"},
}


def _bucket(n: int) -> str:
    return next((f"<{k}" for k in (1, 3, 7, 9, 12, 17, 20) if n < k), "20+")


def iban(s: str) -> bool:
    x = s.replace(" ", "")
    return bool(_IBAN.fullmatch(s)) and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def segment_features(text: str, start: int, end: int, before: list[str], tokens: int) -> list[str]:
    """Features of a whole segment; ``before``: the up to three tokens ahead of it."""
    s = text[start:end]
    digits = _digits(s)
    out = ["bias", f"digits{_bucket(len(digits))}", f"tokens{tokens}", f"first_{'d' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}"]
    out += [name for name, ok in (
        ("spelt", _SPELT.fullmatch(s)), ("ipv6", _IPV6.fullmatch(s)), ("hex", _HEX.fullmatch(s)), ("long_key", _LONG_KEY.fullmatch(s)),
        ("ssn", _SSN.fullmatch(s)), ("iban", iban(s)), ("aws", _AWS.fullmatch(s)), ("digest", _DIGEST.fullmatch(s)), ("uuid", _UUID.fullmatch(s)), ("assigned", _ASSIGNED.fullmatch(s)), ("mixed", tokens == 1 and len(s) < 20 and _MIXED.fullmatch(s)),
        ("named", tokens == 1 and before and before[-1].strip("\"'`")[-1:] in (":", "=") and before[-1].strip(_EDGE + ":=").lower() in _NEAR["secret"] or len(before) > 1 and before[-1] in (":", "=") and before[-2].strip(_EDGE).lower() in _NEAR["secret"]),
        ("national", _NATIONAL.fullmatch(s)), ("clock", _CLOCK.fullmatch(s)), ("date", _DATE.fullmatch(s)),
        ("card_luhn", 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", s) and luhn(digits)),
        ("letters", any(c.isalpha() for c in s)), ("digits_only", s.isdigit()), ("inner_space", " " in s), ("at", "@" in s or "at)" in s.lower() or "at]" in s.lower()),
        ("quoted", start > 0 and text[start - 1] in "\"'`" and text[end : end + 1] == text[start - 1]), ("currency", start > 0 and text[start - 1] in "$€£"),
    ) if ok]
    words = {w.strip(_EDGE).lower() for w in before}
    out += [f"near_{kind}" for kind, near in _NEAR.items() if words & near]
    if "hex" in out:
        out.append("hex_hashed" if words & _HASHED else "hex_quoted" if "quoted" in out else "hex_bare")
    if "mixed" in out and "named" in out:
        out.append("mixed_named")
    return out


def _islands(text: str, taken: list[Span]) -> Iterator[list[tuple[int, int, bool]]]:
    """Runs of tokens (start, end, whether it is a trigger) outside ``taken``, near triggers."""
    tokens, k = [], 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        tokens.append((a, b, bool(_TRIGGER.search(m.group().strip(_EDGE) or " ") or _TRIGGER.search(m.group())), k < len(taken) and taken[k][0] < b))
    near = np.zeros(len(tokens) + 1, dtype=np.int64)
    for k, (_, _, trigger, used) in enumerate(tokens):
        if trigger and not used:
            near[max(0, k - REACH)] += 1
            near[min(len(tokens), k + REACH + 1)] -= 1
    near = np.cumsum(near)
    run: list[tuple[int, int, bool]] = []
    for k, (a, b, trigger, used) in enumerate(tokens):
        if near[k] and not used:
            run.append((a, b, trigger))
        elif run:
            yield run
            run = []
    if run:
        yield run


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _EDGE and not (text[a] == "(" and text[a + 1 : a + 2].isdigit()):
        a += 1
    while b > a and text[b - 1] in _EDGE and not (text[b - 1] in ")]" and text[max(a, b - 4) : b].lower() in ("(at)", "[at]")):
        b -= 1
    return a, b


def _segments(text: str, run: list[tuple[int, int, bool]]) -> list[tuple[int, int, int, int, list[str]]]:
    """(first token, token after, start, end, features) of every candidate segment of an island."""
    out = []
    for i in range(len(run)):
        trigger = False
        for j in range(i, min(len(run), i + TOKENS)):
            trigger = trigger or run[j][2]
            if j > i and run[j][1] - run[i][0] > CHARS + 8:
                break
            if not trigger:
                continue
            a, b = _trimmed(text, run[i][0], run[j][1])
            if 0 < b - a and (j == i or b - a <= CHARS):
                before = text[max(0, a - 40) : a].split()[-3:]
                out.append((i, j + 1, a, b, segment_features(text, a, b, before, j + 1 - i)))
    return out


class Field:
    """Weights by feature and kind, and transitions between kinds; kind 0 is outside."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(KINDS)))
        self.move = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, features: list[str]) -> np.ndarray:
        return self.w[[self.index[f] for f in features if f in self.index]].sum(0)

    def label(self, text: str, run: list[tuple[int, int, bool]]) -> list[Span]:
        """The best segmentation of an island."""
        ends: dict[int, list] = {}
        for i, j, a, b, features in _segments(text, run):
            ends.setdefault(j, []).append((i, a, b, self.scores(features)))
        if not any(x[3].max() > 0 for xs in ends.values() for x in xs):
            return []  # moves are never above zero, so nothing can beat staying outside
        best = np.full((len(run) + 1, len(KINDS) + 1), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple] = {}
        for j in range(1, len(run) + 1):
            reach = best[j - 1] + self.move[:, 0]
            best[j, 0], back[j, 0] = reach.max(), (j - 1, int(reach.argmax()), None)
            for i, a, b, s in ends.get(j, ()):
                step = best[i][:, None] + self.move[:, 1:]
                total, prior = step.max(0) + s, step.argmax(0)
                for k in np.flatnonzero(total > best[j, 1:]):
                    best[j, k + 1], back[j, k + 1] = total[k], (i, int(prior[k]), (a, b, KINDS[k]))
        out, j, k = [], len(run), int(best[-1].argmax())
        while j:
            j, k, span = back[j, k]
            if span:
                out.append(span)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.exp(x - top).sum(axis) + 1e-300) + top.squeeze(axis)


def _made(r: random.Random) -> tuple[str, list[Span]]:
    """A sentence by rule, with what the field should add to the fixed patterns."""
    word = lambda: "".join(r.choice("aeiourstlnmdbcpgh") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        d = "4" + num(14)
        d = next(d + str(k) for k in range(10) if luhn(d + str(k)))
        return r.choice("./").join(d[k : k + 4] for k in range(0, 16, 4))

    def account() -> str:
        body = num(r.choice([16, 18, 20, 23]))
        x = f"DE{98 - int(body + '131400') % 97:02}{body}"
        return " ".join(x[k : k + 4] for k in range(0, len(x), 4)) if r.random() < 0.6 else x

    base64 = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n - 1)) + num(1)
    url64 = lambda n: base64(n).replace("+", "-").replace("/", "_")
    # a password is told by what it stands after
    named = lambda make: lambda: ("password: ", "pwd: ", "secret = ", "Password: ", "passwd = ")[r.randrange(5)] + make()

    wanted = [
        ("email", lambda: f"{word()} (at) {word()} (dot) {r.choice(['com', 'org'])}"), ("email", lambda: f"{word()}[at]{word()}.{r.choice(['net', 'com'])}"),
        ("email", lambda: f"{word()} at {word()} dot {r.choice(['com', 'org'])}"), ("email", lambda: f"{word()}(at){word()}.com"),
        ("ip", lambda: ":".join(hexa(4) for _ in range(8))), ("ip", lambda: f"{hexa(4)}:{hexa(3)}::{hexa(4)}:{num(2)}"),
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}"), ("phone", lambda: f"0{num(2)} {num(4)} {num(4)}"),
        ("card", card), ("secret", lambda: hexa(r.randint(24, 64))), ("secret", lambda: "sk" + num(2) + "".join(r.choice("ABCDEFxyzuvw0123456789_") for _ in range(28))),
        ("secret", lambda: r.choice(["AKIA", "ASIA"]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + num(1)), ("secret", lambda: base64(r.randint(30, 200))),
        ("secret", lambda: f"eyJ{url64(r.randint(15, 40))}.eyJ{url64(r.randint(20, 90))}.{url64(43)}"), ("secret", named(lambda: word() + num(r.randint(1, 4)) + r.choice(["", "x"]))), ("secret", lambda: r.choice(["password=", "token=", "secret:", "api_key="]) + word() + num(r.randint(2, 4)) + word()),
        ("id", lambda: f"{num(3)}-{num(2)}-{num(4)}"), ("id", account),
    ]
    unwanted = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}", lambda: str(r.randint(0, 3000)), lambda: f"{num(1)}.{num(1)}.",
        lambda: f"${r.randint(1, 999)},{num(3)}.{num(2)}", lambda: f"{num(2)}-{num(2)}", lambda: num(r.choice([5, 7, 8, 10, 13, 16])), lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"978-0-{num(3)}-{num(5)}-{num(1)}",
        lambda: f"pp. {num(3)}-{num(3)}", lambda: f"{word()}-{num(2)}", lambda: f"{num(2)}%", lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: f"{num(1)}.{num(5)}, {num(2)}.{num(4)}", lambda: "@" + word(), lambda: hexa(r.randint(6, 12)),
        lambda: f"the dot {word()}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"{num(3)}, {num(3)}, {num(3)}", lambda: f"{word()} (at) {word()}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(4)} {num(4)}",
        lambda: f"{r.choice(['commit', 'Merge', 'git', 'rev', 'revision', 'hash', 'checksum'])} {hexa(40)}", lambda: f"{r.choice(['sha256', 'md5', 'sha1'])}:{hexa(r.choice([32, 40, 64]))}", lambda: f"{r.choice(['SHA256', 'digest', 'md5'])} {hexa(r.choice([32, 64]))}",
        lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: word() + num(r.randint(1, 4)), lambda: f"{r.choice(['key', 'token', 'secret', 'password'])} {r.choice([word() + num(1), num(2), 'v' + num(1)])}", lambda: f"{word().upper()}-{num(4)}-{word().upper()}",
    ]
    text, spans = word(), []
    for _ in range(r.randint(1, 3)):
        text += "".join(f" {word()}" for _ in range(r.randint(0, 3)))
        if r.random() < 0.5:
            kind, make = r.choice(wanted)
            if r.random() < 0.5:
                text += " " + r.choice(sorted(_NEAR[kind])) + r.choice(["", ":", " ="])
            quote = '"' if kind == "secret" and r.random() < 0.5 else ""
            text += " " + quote
            made = make()
            if (at := re.match("[a-zA-Z]+(?:: | = )", made)) and kind == "secret":  # what a password stands after is no part of it
                text, made = text.rstrip('"') + at[0], made[at.end() :]
                quote = ""
            spans.append((len(text), len(text) + len(made), kind))
            text += made + quote + r.choice(["", "", ".", ",", "%%%"])
        else:
            near = r.choice(sorted(set().union(*_NEAR.values()))) + " " if r.random() < 0.15 else ""
            text += " " + near + r.choice(unwanted)() + r.choice(["", "", ",", "."])
    text += "".join(f" {word()}" for _ in range(r.randint(0, 3)))
    return text, spans


@cache
def trained(sentences: int = 900, rounds: int = 6, seed: int = 7) -> Field:
    """The field, fitted by stochastic ascent (Adagrad) of the conditional likelihood."""
    r, field, data = random.Random(seed), Field(), []
    for _ in range(sentences):
        text, spans = _made(r)
        taken = base_spans(text)
        spans = [s for s in spans if not any(a < s[1] and s[0] < b for a, b, _ in taken)]
        for run in _islands(text, taken):
            segments = [(i, j, [field.index.setdefault(f, len(field.index)) for f in fs], {(a, b): k for a, b, k in spans}.get((a, b))) for i, j, a, b, fs in _segments(text, run)]
            # of segments that trim to the same span the one of fewest tokens is the labelled one
            gold = {}
            for n, (i, j, _, kind) in enumerate(segments):
                if kind:
                    key = kind, i
                    gold[key] = n
            data.append((len(run), segments, sorted(gold.values(), key=lambda n: segments[n][0])))
    kinds = len(KINDS)
    field.w, speed = np.zeros((len(field.index), kinds)), np.full((len(field.index), kinds), 1e-2)
    pace = np.full_like(field.move, 1e-2)
    for _ in range(rounds):
        r.shuffle(data)
        for n, segments, gold in data:
            move = field.move
            scores = [field.w[fs].sum(0) for _, _, fs, _ in segments]
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for m, (i, j, _, _) in enumerate(segments):
                by_end.setdefault(j, []).append(m)
                by_start.setdefault(i, []).append(m)
            fore, into = np.full((n + 1, kinds + 1), -np.inf), np.zeros((n + 1, kinds + 1))
            fore[0, 0] = 0.0
            for j in range(n + 1):
                if j:
                    parts = [np.append(into[j - 1, 0], np.full(kinds, -np.inf))] + [np.append(-np.inf, into[segments[m][0], 1:] + scores[m]) for m in by_end.get(j, ())]
                    fore[j] = _log_sum(np.array(parts), 0)
                into[j] = _log_sum(fore[j][:, None] + move, 0)
            aft = np.full((n + 1, kinds + 1), -np.inf)
            aft[n] = 0.0
            grad_move = np.zeros_like(move)
            whole = float(_log_sum(fore[n], 0))
            for i in range(n - 1, -1, -1):
                onward = np.append(aft[i + 1, 0], np.full(kinds, -np.inf))
                ahead = [onward] + [np.append(-np.inf, scores[m] + aft[segments[m][1], 1:]) for m in by_start.get(i, ())]
                onward = _log_sum(np.array(ahead), 0)
                aft[i] = _log_sum(move + onward[None, :], 1)
                grad_move -= np.exp(np.minimum(fore[i][:, None] + move + onward[None, :] - whole, 0))
            grad: dict[int, np.ndarray] = {}
            for m, (i, j, fs, _) in enumerate(segments):
                p = -np.exp(np.minimum(into[i, 1:] + scores[m] + aft[j, 1:] - whole, 0))
                for f in fs:
                    grad[f] = grad.get(f, 0.0) + p
            prior, at = 0, 0
            for m in gold:
                i, j, fs, kind = segments[m]
                if i < at:
                    continue
                k = KINDS.index(kind)
                for f in fs:
                    grad[f][k] += 1
                for _ in range(at, i):
                    grad_move[prior, 0] += 1
                    prior = 0
                grad_move[prior, k + 1] += 1
                prior, at = k + 1, j
            for _ in range(at, n):
                grad_move[prior, 0] += 1
                prior = 0
            rows = np.fromiter(grad, dtype=np.int64)
            if len(rows):
                g = np.array([grad[f] for f in rows]) - 1e-3 * field.w[rows]
                speed[rows] += g * g
                field.w[rows] += 0.5 * g / np.sqrt(speed[rows])
            pace += grad_move**2
            field.move = np.minimum(move + 0.1 * grad_move / np.sqrt(pace), 0.0)
            field.move[:, 0] = 0.0  # going outside is the zero point
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The fixed patterns' spans, and these with the field's, in order."""
    base = base_spans(text)
    if not _ANY_TRIGGER.search(text):
        return base, base
    taken, last = [], -1
    for a, b, k in base:  # spans of several kinds may overlap
        if b > last:
            taken.append((max(a, last), b, k))
            last = b
    more = [s for run in _islands(text, taken) for s in field.label(text, run)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame) -> DataFrame:
    """For every whole text the counts and hash of the fixed patterns' spans, and all spans as text."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("pii")
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                base, every = all_spans(text.as_py() or "", field)
                rows.append((doc, *(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping ones, replaced by its kind in brackets."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null."""
    field = trained()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("pii")
        for b in batches:
            made = [None if (x := t.as_py()) is None else redact(x, all_spans(x, field)[1]) for t in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array(made, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
