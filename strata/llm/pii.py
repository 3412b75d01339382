"""Personal data: patterns with checks, and a linear-chain conditional random field.

Patterns give the base spans: email, ip, card (Luhn) and phone.  A conditional random field over
word-shape features adds what they miss: numbers written in other ways, and secrets.  It is
trained here, in numpy, from the labelled table below, some hundred lines in four languages whose
values are made by rule; words are features of their own shape and of their neighbours', lines are sequences, and Viterbi decodes batches of lines of
similar length.  A word's features depend on the word alone, so each different word is looked at
once per task (in a map of bounded size) and a sequence is three table lookups per word.

Every whole text is read.  Memory is bounded by ``SLICE`` texts at a time.

Defined results: a null or empty text has no spans; repeated rows get equal results; positions
count code points, ends are exclusive; an added span never overlaps a base span; other columns
are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import ship

ship(__name__)

KINDS = ("email", "ip", "card", "phone", "secret")  # the base kinds first, in this order
TAGS = ("other", *KINDS)
SLICE = 128
CACHE = 300_000
LINES = 256

# --- base patterns ----------------------------------------------------------------------------
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number's later digits can't begin a match where its first failed: the look-behind skips them.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Around every @: as much of the local part as is free, then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    if not DIGIT.search(text):
        return sorted(out)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the labelled table --------------------------------------------------------------------------
# Lines with slots; each is filled several times with values made by rule.  [kind words] marks personal
# data, all else is other.  A slot: {what}; 9 stands for any digit in PHONES.
PHONES = ("999-999-9999", "(999) 999-9999", "999.999.9999", "1-800-999-9999", "099 9999 9999", "0999-9999999", "099/999999", "09 99 99 99 99",
          "999 99 99 99", "099 999 9999", "+99 99 9999 9999", "0099 99 999 9999", "09999 999999", "999-9999")
CARDS = (("4", 16, " "), ("5", 16, "-"), ("4", 16, ""), ("3", 15, " "), ("6", 16, "."))
LINES_OF = {
    "phone": """please call me at [phone {phone}] tomorrow
my phone is [phone {phone}] and I answer late
tel [phone {phone}] or fax [phone {phone}]
phone: [phone {phone}], office hours nine to five
ring [phone {phone}] for help
mobile [phone {phone}] after six
she left the number [phone {phone}] with us
telefon [phone {phone}] abends ab acht
rufen sie [phone {phone}] an
appelez le [phone {phone}] ce soir
téléphone : [phone {phone}]
llame al [phone {phone}] por la tarde
teléfono [phone {phone}] de la oficina
contact: {name}, [phone {phone}]""",
    "email": """write to [email {odd_email}] soon
contact [email {odd_email}] for the file
mail [email {odd_email}] if it breaks
my address is [email {odd_email}] , thanks
send it to [email {email}] and to [email {odd_email}]
schreiben sie an [email {odd_email}] bitte
écrivez à [email {odd_email}] pour plus
escriba a [email {odd_email}] hoy
email: [email {email}]""",
    "ip": """host [ip {ipv6}] answered
the server [ip {ipv4}] went down
ping [ip {ipv6}] twice
connect from [ip {ipv6}] port 22
listening on [ip {ipv6}] now
address [ip {ipv6}] was blocked
der server [ip {ipv6}] ist weg
le serveur [ip {ipv6}] répond""",
    "card": """card [card {card}] was declined
she paid with [card {card}] yesterday
number [card {card}] on the slip
visa [card {card}] expires in May
karte [card {card}] gesperrt
carte [card {card}] refusée
tarjeta [card {card}] vencida""",
    "secret": """login with [secret password={password}] please
the [secret password={password}] leaked
password: [secret {password}]
password is [secret {password}] , change it
passwort: [secret {password}]
mot de passe : [secret {password}]
contraseña: [secret {password}]
set token = [secret "{hex}"] in the file
token = [secret "{hex}"]
token = [secret '{base64}'] was posted
api key = [secret "{prefixed}"] here
api_key: [secret {prefixed}]
secret: [secret {hex}] expires
secret = [secret {base64}]
export [secret API_KEY={hex}] first
export [secret AUTH_TOKEN={prefixed}]
[secret {aws}] is the access key
aws key [secret {aws}] in the log
bearer [secret {jwt}]
authorization: bearer [secret {jwt}]
[secret {prefixed}]""",
    "other": """{prose}
{prose} {prose}
in {year} sales rose by 4.5 percent to 1,200 units.
see page {small} and chapter 7 of volume 3
version 2.{small}.1 fixes issue {number} since May {year}
it costs $1,{three}.50 or {small} euros for 12 pieces
on 12/05/{year} at 18:30 we met {small} people
from {year} to {year} and 1939-1945 nothing moved
he ran 100 m in 9.58 s , a record since {year}
Licensed under CC BY-NC 4.0. and ISO 9001:2015 rules
Version 2.0. of the License, January {year}
chapter 3.2.1 says 10-12 items of {number} are fine
the population was 3,{three},000 in {year} and {number} later
x = {small} + 4 * y and f(x) = 2
the winner has {number} points , room {three} , row {small}
a {small}-year-old man and a 3-day trip
John's book , well-known and state-of-the-art
"Yes," she said ; (see below) !
http://example.com/index.html?id={small} is a page
www.example.org and example.net are names
the U.S. and the E.U. met in Q3
commit {sha} fixes the build
merge commit {sha}
git checkout {sha}
checksum {sha} of the file
sha256 {sha}
IBAN {iban} please
account {iban} was closed
ISBN 978-3-16-148410-0 of the book
order number {number} shipped on {year}-05-{small}
parcel 1Z{number}AA{number} arrives
| {word} | {word} | {word} | {small} |
{word}$$$ {word}%%% {word} &&& {word}***
{word} {word} ### {word} >>> {word}
the key {word} of the {word} in {year}
the token {word} is a {word}
a password must have {small} letters
secret {word} , secret {word}
call the {word} of {word}
the phone {word} in the card {word}
time 12:30:45 , ratio 16:9 , score 3:2
coordinates 48.8566, 2.3522 and 40.7128, -74.0060
in {prose} at {small}:30 {prose}""",
}
TIMES = {"phone": 5, "email": 7, "ip": 6, "card": 6, "secret": 6, "other": 4}  # each line so often
SYLLABLES = ("ka lo mi ra ten sol var dim pel nor gu ish ang oth ber lin dor val mer ton rue bel cha ver ent ich ung der "
             "que ion ar os la el ado mente que per con tra sin").split()


def _maker(seed: int):
    """Values by rule, the same for equal seeds."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))

    def card() -> str:
        first, n, by = r.choice(CARDS)
        body = first + digits(n - 2)
        body += next(d for d in "0123456789" if luhn(body + d))
        cut = (4, 6, 5) if n == 15 else (4, 4, 4, 4)
        at = [sum(cut[:i]) for i in range(len(cut))]
        return by.join(body[i:i + k] for i, k in zip(at, cut))

    def email() -> str:
        return f"{word()}{r.choice(['.', '_', '', '-'])}{word()}{r.choice(['', digits(2)])}@{word()}.{r.choice(['org', 'net', 'com', 'de', 'fr', 'es'])}"

    def odd_email() -> str:
        name, host, top = word(), word(), r.choice(["org", "net", "com", "de", "fr", "es"])
        return r.choice([f"{name}(at){host}.{top}", f"{name} (at) {host}.{top}", f"{name} [at] {host} [dot] {top}", f"{name}[at]{host}.{top}",
                         f"{name}(at){host}(dot){top}", f"{name} (at) {host} (dot) {top}"])

    def ipv6() -> str:
        groups = [hexes(r.randint(1, 4)) for _ in range(8)]
        return r.choice([":".join(groups), "2001:db8::" + ":".join(groups[:2]), "fe80::" + ":".join(groups[:r.randint(1, 4)]), "::" + ":".join(groups[:3])])

    def password() -> str:
        return r.choice([word() + digits(r.randint(2, 4)), word().capitalize() + digits(2) + r.choice("!?&#x"), word() + digits(1) + word() + digits(1),
                         "".join(r.choice(mixed) for _ in range(r.randint(8, 14))) + digits(1), hexes(18)])

    prefixed = lambda: r.choice(["sk-", "ghp_", "xoxb-", "pk_live_", "glpat-"]) + "".join(r.choice(mixed) for _ in range(r.randint(20, 36)))
    part = lambda n: "".join(r.choice(mixed + "-_") for _ in range(n))
    return {"phone": lambda: re.sub("9", lambda _: digits(1), r.choice(PHONES)), "card": card, "email": email, "odd_email": odd_email, "ipv6": ipv6,
            "ipv4": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), "password": password, "hex": lambda: hexes(r.choice([25, 32, 40, 64])),
            "base64": lambda: "".join(r.choice(mixed + "+/") for _ in range(r.choice([28, 43]))) + "=", "prefixed": prefixed,
            "aws": lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
            "jwt": lambda: f"eyJ{part(17)}.eyJ{part(40)}.{part(43)}", "sha": lambda: hexes(r.choice([7, 40, 40, 64])),
            "iban": lambda: r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + r.choice([" ".join(digits(4) for _ in range(5)), digits(18)]),
            "year": lambda: str(r.randint(1900, 2030)), "small": lambda: str(r.randint(1, 60)), "three": lambda: digits(3), "number": lambda: digits(r.randint(4, 7)),
            "word": word, "name": lambda: word().capitalize(), "prose": lambda: " ".join(word() for _ in range(r.randint(4, 9))) + r.choice(["", ".", ","])}


def labelled_lines(seed: int = 1, lines: dict[str, str] = LINES_OF, times: dict[str, int] = TIMES) -> list[str]:
    """The lines with their slots filled, each as often as its kind says."""
    make = _maker(seed)
    return [re.sub(r"\{(\w+)\}", lambda m: make[m[1]](), line) for kind, text in lines.items() for line in text.split("\n") for _ in range(times[kind])]


def labelled(lines: Sequence[str] | None = None) -> list[tuple[list[str], list[int]]]:
    out = []
    for line in labelled_lines() if lines is None else lines:
        words, tags, at = [], [], 0
        marks = [(m.start(), m.end(), m[1], m[2]) for m in MARKED.finditer(line)]
        for start, end, kind, text in [*marks, (len(line), len(line), "", "")]:
            plain = line[at:start].split()
            own = text.split()
            # punctuation right behind a mark belongs to its last word
            if words and at and line[at:at + 1].strip() and plain:
                words[-1] += plain.pop(0)
            words += plain + own
            tags += [0] * len(plain) + [TAGS.index(kind) if kind else 0] * len(own)
            at = end
        out.append((words, tags))
    return out


MARKED = re.compile(r"\[(%s) ((?:[^\[\]]|\[(?:at|dot)\])+)\]" % "|".join(KINDS))
PUNCTUATION = ".,;:!?()\"'[]"


# --- features -----------------------------------------------------------------------------------
CUES = frozenset("call phone tel fax telefon téléphone teléfono mobile dial ring appelez llame rufen contact mail email write card visa karte carte "
                 "tarjeta number password passwort passe contraseña token secret key api_key bearer authorization server host ping commit checkout "
                 "checksum sha256 iban isbn account login export".split())


def shape(word: str, most: int = 12) -> str:
    """Letters and digits by kind, runs collapsed, other characters as they are."""
    out: list[str] = []
    for ch in word:
        s = "d" if "0" <= ch <= "9" else "X" if ch.isupper() else "x" if ch.isalpha() else ch if ord(ch) < 128 else "~"
        if not out or out[-1] != s:
            out.append(s)
            if len(out) == most:
                break
    return "".join(out)


def features(word: str) -> tuple[str, ...]:
    bare = word.strip(PUNCTUATION)
    digits = sum("0" <= c <= "9" for c in bare)
    letters = sum(c.isalpha() for c in bare)
    size = lambda n: next(i for i, top in enumerate((0, 1, 2, 3, 4, 6, 9, 13, 16, 19, 10 ** 9)) if n <= top)
    out = ["bias", f"shape={shape(bare)}", f"digits={size(digits)}"]
    if bare.lower().rstrip(":=") in CUES:
        out.append(f"cue={bare.lower().rstrip(':=')}")
    if "@" in bare or re.search(r"[(\[](?:at|dot)[)\]]", word):
        out.append("at")
    if re.fullmatch(r"[0-9a-f]{7,}", bare) and digits and letters:
        out.append(f"hex={size(len(bare))}")
    if bare.count(":") > 1 and re.fullmatch(r"[0-9a-fA-F:]+", bare):
        out.append("colons")
    known = re.match(r"AKIA|eyJ|sk-|ghp_|xoxb-|pk_live_|glpat-", bare)
    if known:
        out.append(f"begins={known[0]}")
    if re.match(r"[A-Z]{2}[0-9]{2}", bare):
        out.append("country")
    if digits and letters:
        out.append(f"mixed={min(4, len(bare) // 8)}")
    if digits and not letters:
        out.append(f"number={size(digits)},{''.join(sorted(set(re.sub('[0-9]', '', bare))))[:4]}")
    if not digits and letters:
        out.append("letters")
    if word[:1] == '"' and word[-1:] == '"' and len(bare) > 12:
        out.append("quoted")
    if "=" in bare:
        out.append("assigns")
        if bare.split("=")[0].lower().split("_")[-1] in CUES:
            out.append("assigns cue")
    return tuple(out)


# --- the model ------------------------------------------------------------------------------------
@dataclass
class Field:
    """Weights of (neighbour, feature, tag) and (tag, next tag)."""
    index: dict[str, int]
    weights: np.ndarray  # 3 neighbours (before, own, after) x features x tags
    moves: np.ndarray

    def rows(self, word: str) -> np.ndarray:
        """3 x tags: what the word gives its successor's, its own and its predecessor's tag."""
        known = [self.index[f] for f in features(word) if f in self.index]
        return self.weights[:, known].sum(axis=1)


def _emissions(own: np.ndarray) -> np.ndarray:
    """``own``: words x 3 x tags -> scores of each word's tags from itself and its neighbours."""
    e = own[:, 1].copy()
    e[1:] += own[:-1, 0]
    e[:-1] += own[1:, 2]
    return e


def train(table: Sequence[tuple[list[str], list[int]]] | None = None, steps: int = 120, rate: float = 0.1,
          decay: float = 0.002) -> Field:
    """Maximum likelihood with weight decay, by Adam; gradients by forward and backward sums over all
    sequences at once."""
    table = [t for t in (labelled() if table is None else table) if t[0]]
    index = {f: i for i, f in enumerate(dict.fromkeys(f for words, _ in table for w in words for f in features(w)))}
    n, k = len(index), len(TAGS)
    field = Field(index, np.zeros((3, n, k)), np.zeros((k, k)))
    if not table:
        return field
    table.sort(key=lambda t: -len(t[0]))
    lengths = np.array([len(w) for w, _ in table])
    count, longest = len(table), int(lengths[0])
    per_word = [[index[f] for f in features(w)] for words, _ in table for w in words]
    word_of = np.repeat(np.arange(len(per_word)), [len(f) for f in per_word])  # the word of each of its features
    feature = np.concatenate(per_word)
    row, col = np.repeat(np.arange(count), lengths), np.concatenate([np.arange(x) for x in lengths])
    place = np.zeros((count, longest), np.int64)
    place[row, col] = np.arange(len(row))
    gold = np.concatenate([tags for _, tags in table])
    follows, leads = np.flatnonzero(col > 0), np.flatnonzero(col < lengths[row] - 1)
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    truth = np.zeros((k, k))
    np.add.at(truth, (gold[follows - 1], gold[follows]), 1)
    params = [field.weights, field.moves]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    starts = np.searchsorted(word_of, np.arange(len(per_word)))
    for t in range(1, steps + 1):
        own = np.add.reduceat(field.weights[:, feature], starts, axis=1)  # 3 x words x tags
        e = own[1].copy()
        e[follows] += own[0, follows - 1]
        e[leads] += own[2, leads + 1]
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[place[:, 0]] = e[place[:, 0]]
        for i in range(1, longest):
            at, before = place[:alive[i], i], place[:alive[i], i - 1]
            ahead[at] = e[at] + _logsum(ahead[before][:, :, None] + field.moves, 1)
        for i in range(longest - 1, 0, -1):
            at, before = place[:alive[i], i], place[:alive[i], i - 1]
            back[before] = _logsum(field.moves + (e[at] + back[at])[:, None, :], 2)
        z = _logsum(ahead[place[np.arange(count), lengths - 1]], 1)[row]
        p = np.exp(ahead + back - z[:, None])
        between = np.exp(ahead[follows - 1][:, :, None] + field.moves + (e[follows] + back[follows])[:, None, :] - z[follows][:, None, None])
        p[np.arange(len(p)), gold] -= 1
        slopes = np.zeros((3, len(p), k))
        slopes[1] = p
        slopes[0, follows - 1] = p[follows]
        slopes[2, leads + 1] = p[leads]
        g_weights = np.stack([np.stack([np.bincount(feature, slopes[j, word_of, c], minlength=n) for c in range(k)], axis=1) for j in range(3)])
        grads = [g_weights + decay * count * field.weights, between.sum(axis=0) - truth + decay * count * field.moves]
        for x, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-8)
    return field


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def viterbi(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of a batch: ``e`` is sequences x steps x tags, longest first; steps past a
    sequence's length are 0."""
    n, steps, k = e.shape
    score, back = e[:, 0].copy(), np.zeros((steps, n, k), np.int8)
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than the step
    for t in range(1, steps):
        a = alive[t]
        through = score[:a, :, None] + moves
        back[t, :a] = through.argmax(axis=1)
        score[:a] = through.max(axis=1) + e[:a, t]
    tags = np.zeros((n, steps), np.int8)
    tags[np.arange(n), lengths - 1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        a = alive[t]
        tags[:a, t - 1] = back[t, np.arange(a), tags[:a, t]]
    return tags


class Decoder:
    """Spans of texts; a different word's rows are worked out once."""

    def __init__(self, field: Field):
        self.field, self.ids, self.by_shape = field, {}, {}
        self.own = np.zeros((1024, 3, len(TAGS)))

    def _learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > CACHE:
            self.ids.clear()
        for w in words.difference(self.ids):
            bare = w.strip(PUNCTUATION)
            # most words are plain: letters alone, in lower case or capitalised, and no cue
            like = w
            if bare.isalpha() and w[0] not in '"([' and bare.lower() not in CUES:
                like = "a" if bare.islower() else "Aa" if bare[0].isupper() and bare[1:].islower() else w
            i = self.ids.get(like)
            if i is not None:
                self.ids[w] = i
                continue
            f = tuple(x for x in features(like) if x in self.field.index)
            i = self.by_shape.get(f)
            if i is None:
                i = self.by_shape[f] = len(self.by_shape)
                if i == len(self.own):
                    self.own = np.concatenate([self.own, np.zeros_like(self.own)])
                self.own[i] = self.field.rows(w)
            self.ids[w] = self.ids[like] = i

    def tagged_lines(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Tags of every line's words."""
        self._learn({w for ws in lines for w in ws})
        order = sorted((i for i, ws in enumerate(lines) if ws), key=lambda i: -len(lines[i]))
        out = [np.empty(0, np.int8)] * len(lines)
        at = 0
        while at < len(order):
            longest = len(lines[order[at]])
            part = order[at:at + max(1, min(LINES, 500_000 // longest))]
            at += len(part)
            lengths = np.array([len(lines[i]) for i in part])
            e = np.zeros((len(part), longest, len(TAGS)))
            row, col = np.repeat(np.arange(len(part)), lengths), np.concatenate([np.arange(x) for x in lengths])
            own = self.own[np.array([self.ids[w] for i in part for w in lines[i]])]
            e[row, col] = own[:, 1]
            follows, leads = np.flatnonzero(col > 0), np.flatnonzero(col < lengths[row] - 1)
            e[row[follows], col[follows]] += own[follows - 1, 0]
            e[row[leads], col[leads]] += own[leads + 1, 2]
            tags = viterbi(e, lengths, self.field.moves)
            for j, i in enumerate(part):
                out[i] = tags[j, :lengths[j]]
        return out

    def spans(self, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
        """Per text its base spans and the spans that the field adds."""
        lines = [t.split("\n") for t in texts]
        tags = self.tagged_lines([x.split() for ls in lines for x in ls])
        out, k = [], 0
        for text, ls in zip(texts, lines, strict=True):
            base, added, start = base_spans(text), [], 0
            for line in ls:
                if tags[k].any():
                    added += _line_spans(line, tags[k], start)
                start += len(line) + 1
                k += 1
            out.append((base, _apart(added, base)))
        return out


def _apart(added: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``added`` that overlap none of ``base``; both are sorted by start, and are read once."""
    out, i, reach = [], 0, 0
    for s in added:
        while i < len(base) and base[i][0] < s[1]:
            reach = max(reach, base[i][1])
            i += 1
        if reach <= s[0]:
            out.append(s)
    return out


def plausible(text: str, kind: str) -> bool:
    """An added span keeps to what its kind must be: numbers that fail a base check stay out."""
    digits = "".join(DIGIT.findall(text))
    if kind == "email":
        return bool(re.search(r"@|[(\[]at[)\]]", text))
    if kind == "ip":
        return (text.count(":") > 1 and bool(re.fullmatch(r"[0-9A-Fa-f:.]+", text))) or bool(base_spans(text))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 if kind == "phone" else len(text) >= 6 and len(digits) > 0


OUTER = "#$%&*|<>~^.,;:!?)}\"'`"  # not the end of any kind
KEYED = re.compile(r"[\"']?\w*(?:password|passwort|passwd|pwd|token|secret|key)\w*[\"']?[=:]+[\"']?", re.IGNORECASE)


def trimmed(line: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The boundaries of a span inside its outer words: less punctuation around it, an opening bracket
    whose partner is outside, and, for a secret, the name that it is assigned to."""
    while b > a and line[b - 1] in OUTER and not (line[b - 1] == ")" and line[a:b].endswith(("(at)", "(dot)"))):
        b -= 1
    while a < b and line[a] in "\"'`[{|<>#$%&*" and not line.startswith("[at]", a):
        a += 1
    if kind == "secret":
        m = KEYED.match(line, a, b)
        if m and m.end() < b:
            a = m.end()
    if kind != "phone" and a < b and line[a] == "(" and ")" not in line[a:b]:
        a += 1
    return a, b


def _line_spans(line: str, tags: np.ndarray, offset: int) -> list[Span]:
    """Neighbouring words of one kind make a span, trimmed; words of a secret are spans of their own."""
    out, at = [], [m.span() for m in re.finditer(r"\S+", line)]
    i = 0
    while i < len(at):
        j = i
        kind = TAGS[tags[i]]
        while j + 1 < len(at) and tags[j + 1] == tags[i] and kind != "secret":
            j += 1
        if tags[i]:
            a, b = trimmed(line, at[i][0], at[j][1], kind)
            if plausible(line[a:b], kind):
                out.append((offset + a, offset + b, kind))
        i = j + 1
    return out


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, base, added``: arrays of ``start, end, kind`` of every text, by start."""
    field = field or train()
    # plain values: a broadcast object would need this library on the executors
    shared = docs.sparkSession.sparkContext.broadcast((field.index, field.weights, field.moves))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    row = lambda s: {"start": s[0], "end": s[1], "kind": s[2]}

    def run(batches):
        decoder = Decoder(Field(*shared.value))
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                found = decoder.spans([t or "" for t in part.column("text").to_pylist()])
                base, added = (pa.array([[row(s) for s in f[j]] for f in found], span) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), base, added], ["doc_id", "base", "added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:int,end:int,kind:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spans}, added {spans}")
