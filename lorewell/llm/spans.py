"""Made-up labelled text for training and testing the personal-data tagger.

``sample(rng, n)`` returns n (text bytes, label bytes) of invented words in which
personal data and look-alikes (versions, dates, prices, times, web addresses, book
and order numbers, digests, long words) stand; label 0 is ordinary text, the
others are the positions of ``KINDS``.  Forms are drawn from the conventions of
many countries and services, part by part, and what tells a secret or an official
number from a look-alike is the word before it, as in real text.
"""

from __future__ import annotations

import string
import unicodedata

import numpy as np

KINDS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
#: Sounds of several European languages in Latin letters.
_ONSET = "b c d f g h j k l m n p qu r s t v w x z ch sh th tr st pr gl nd rr ll ñ ç ß pf tz sch schw kl kr br fl fr gr bl cl dr sp sk sz cz kn gn wr wh ph".split()
_VOWEL = "a e i o u a e i o u ea ou ie io ei au eu eau ai oi ue é è ê á í ó ú à â î ô û ö ü ä å ø y".split()
_CODA = ["", "", "", "", "n", "r", "s", "t", "nt", "tion", "ing", "ment", "keit", "heit", "lich", "ung", "schaft", "ch", "l", "pf", "tz", "ck", "ng", "st", "ness", "able", "eux", "aux", "ción", "dad", "mente", "os", "as", "en", "er"]
_END = [" "] * 36 + [", ", ". ", ".\n", "\n", "; ", ": ", " - ", " | ", "! ", "? ", " (", ") ", "' ", '" ', " / ", "\t", "\r\n", " – "]
_HEX, _LOW, _UP, _DIGIT = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.digits
_ALNUM = _LOW + _UP + _DIGIT
_TLD = "com org net de fr es io it nl eu info biz edu gov co.uk com.br ac.jp example test dev app".split()


def _pick(rng, items):
    return items[int(rng.integers(len(items)))]


def _digits(rng, n):
    return "".join(map(str, rng.integers(0, 10, n)))


def _run(rng, chars, n):
    return "".join(chars[k] for k in rng.integers(0, len(chars), n))


def _other_word(rng) -> str:
    """A word of another script: Greek, Cyrillic, Arabic, Devanagari, CJK or Hangul."""
    low, high = _pick(rng, [(0x3B1, 0x3C9), (0x430, 0x44F), (0x430, 0x44F), (0x627, 0x64A), (0x905, 0x939), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)])
    return "".join(chr(int(c)) for c in rng.integers(low, high + 1, int(rng.integers(1, 9))))


def word(rng) -> str:
    made = "".join(_pick(rng, _ONSET) + _pick(rng, _VOWEL) + _pick(rng, _CODA) for _ in range(int(rng.choice([1, 1, 1, 2, 2, 3, 4, 6]))))
    kind = rng.random()
    return made.capitalize() if kind < 0.1 else made.upper() if kind < 0.13 else made


def _name(rng) -> str:
    """As names stand in addresses and code: mostly small letters without accents."""
    made = word(rng)
    if rng.random() < 0.95:
        made = unicodedata.normalize("NFKD", made.replace("ß", "ss")).encode("ascii", "ignore").decode()
    return made.lower() if rng.random() < 0.9 else made


def email(rng) -> str:
    def part():
        kind = rng.random()
        return _digits(rng, int(rng.integers(1, 5))) if kind < 0.2 else _run(rng, _LOW + _DIGIT, int(rng.integers(1, 9))) if kind < 0.35 else _name(rng)

    def local():
        out = _name(rng) if rng.random() < 0.85 else part()
        for _ in range(int(rng.choice([0, 0, 1, 1, 1, 2]))):
            out += _pick(rng, [".", ".", ".", "_", "-", "+", ""]) + part()
        return out

    labels = [part() if rng.random() < 0.3 else _name(rng) + (_digits(rng, 1) if rng.random() < 0.2 else "") for _ in range(int(rng.choice([1, 1, 1, 2, 2, 3])))]
    return f"{local()}@{'.'.join(x.replace('_', '-') for x in labels)}.{_pick(rng, _TLD)}"


def phone(rng) -> str:
    """[+country] [(area)] groups, with one kind of separator."""
    sep = _pick(rng, [" ", " ", "-", "-", ".", ""])
    country = f"+{int(rng.integers(1, 1000 if rng.random() < 0.2 else 100))}"
    area = _digits(rng, int(rng.integers(2, 5)))
    rest = _pick(rng, [[3, 4], [3, 4], [3, 4], [4, 4], [7], [2, 2, 2, 2], [3, 3], [2, 2, 2], [3, 2, 2], [4, 3]])
    groups = sep.join(_digits(rng, n) for n in rest)
    form = rng.random()
    if form < 0.3:
        return f"{country}{_pick(rng, [' ', ' ', '-', ''])}({area}){_pick(rng, [' ', ' ', ''])}{groups if sep else _digits(rng, 7)}"
    if form < 0.6:
        return f"{country}{sep}{area}{sep}{groups}"
    if form < 0.75:
        return f"({area}){_pick(rng, [' ', '-', ''])}{groups}"
    if form < 0.8:
        return f"00{country[1:]}{sep}{area}{sep}{groups}"
    if form < 0.9:
        return f"{_digits(rng, 3)}{sep or '-'}{_digits(rng, 3)}{sep or '-'}{_digits(rng, 4)}"
    return f"0{_digits(rng, int(rng.integers(2, 5)))}{_pick(rng, ['/', ' ', '-'])}{groups}"


def ip(rng) -> str:
    if rng.random() < 0.85:
        return ".".join(str(int(rng.integers(0, 256))) for _ in range(4))
    groups = [_run(rng, _HEX, int(rng.integers(1, 5))) for _ in range(8)]
    if rng.random() < 0.5:
        return ":".join(groups)
    k = int(rng.integers(1, 6))
    return ":".join(groups[:k]) + "::" + ":".join(groups[k : k + int(rng.integers(1, 4))])


def card(rng) -> str:
    sep = _pick(rng, ["", "", "", " ", "-"])
    groups = _pick(rng, [[4, 4, 4, 4], [4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3]])
    made = sep.join(_digits(rng, n) for n in groups)
    return _pick(rng, "3456") + made[1:] if rng.random() < 0.5 else made


_KEYS = "token api_key apikey secret key access_token auth client_secret password passwd pwd passphrase bearer private_key secret_key auth_token API_KEY TOKEN SECRET Password DB_PASSWORD".split()
_AFTER_KEY = [" = ", " = ", "=", ": ", ": ", ":", " := ", " -> ", " => ", "\t"]


def secret(rng) -> tuple[str, str, str]:
    """(what stands before, the secret, what stands after)"""
    key = _pick(rng, _KEYS)
    if key.lower().startswith("pass") or "pwd" in key or "PASS" in key:
        value = _pick(rng, [lambda: _name(rng) + _digits(rng, int(rng.integers(1, 5))), lambda: _run(rng, _ALNUM + "!#%&*?@^_-+", int(rng.integers(8, 20))), lambda: f"{_name(rng)}{_pick(rng, '!-_.')}{_name(rng)}{_digits(rng, 2)}"])()
    else:
        n = int(rng.integers(16, 65))
        value = _pick(rng, [lambda: _run(rng, _HEX, n), lambda: _run(rng, _HEX, n), lambda: _run(rng, _HEX.upper(), n), lambda: _run(rng, _ALNUM, n), lambda: _run(rng, _ALNUM, n), lambda: _run(rng, _ALNUM + "+/", n) + _pick(rng, ["", "=", "=="]), lambda: _run(rng, _ALNUM + "-_", n)])()
    if rng.random() < 0.2:  # kinds that are known by their beginning, whatever stands before
        value = _pick(rng, ["sk-", "sk_live_", "ghp_", "gho_", "glpat-", "xoxb-", "AKIA", "hf_", "pk_"]) + _run(rng, _ALNUM, int(rng.integers(16, 41)))
        if rng.random() < 0.5:
            return "", value, ""
    if rng.random() < 0.05:
        value = "eyJ" + ".".join(_run(rng, _ALNUM + "-_", int(rng.integers(15, 40))) for _ in range(3))
    quote = _pick(rng, ["", "", '"', '"', "'"])
    name = f"{quote}{key}{quote}" if quote and rng.random() < 0.2 else key
    return f"{name}{_pick(rng, _AFTER_KEY)}{quote}", value, quote


def official(rng) -> tuple[str, str, str]:
    """(what stands before, an identity or account number, what stands after)"""
    if rng.random() < 0.5:
        code, n = _run(rng, _UP, 2) + _digits(rng, 2), int(rng.integers(11, 25))
        body = _digits(rng, n) if rng.random() < 0.7 else _run(rng, _UP + _DIGIT, 4) + _digits(rng, n - 4)
        spaced = " ".join([code, *(body[k : k + 4] for k in range(0, n, 4))])
        return _pick(rng, ["", "IBAN ", "IBAN: ", "account ", "iban="]), _pick(rng, [spaced, code + body]), ""
    if rng.random() < 0.6:
        return _pick(rng, ["SSN ", "SSN: ", "ssn=", "social security number ", "", "Social Security No. "]), f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", ""
    return _pick(rng, ["passport ", "passport no. ", "Passport: ", "tax id ", "national id "]), _run(rng, _UP, int(rng.integers(1, 3))) + _digits(rng, int(rng.integers(6, 10))), ""


def look_alike(rng) -> str:
    d = lambda n: _digits(rng, n)
    w = lambda: word(rng)
    hexes = lambda n: _run(rng, _HEX, n)
    r = lambda a, b: int(rng.integers(a, b))
    return _pick(
        rng,
        [
            lambda: f"{_pick(rng, ['version ', 'v', 'release ', ''])}{r(0, 20)}.{r(0, 30)}",
            lambda: f"{r(0, 20)}.{r(0, 30)}.{r(0, 99)}",
            lambda: f"v{r(0, 20)}.{r(0, 30)}.{r(0, 99)}-{w()}.{r(0, 9)}",
            lambda: f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d}",
            lambda: f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d}T{r(0, 24):02d}:{d(2)}:{d(2)}Z",
            lambda: f"{r(1, 29)}.{r(1, 13)}.{r(1900, 2100)}",
            lambda: f"{r(1, 13)}/{r(1, 29)}/{r(1900, 2100)}",
            lambda: f"{r(0, 24)}:{r(0, 60):02d}",
            lambda: f"{r(0, 24)}:{r(0, 60):02d}:{r(0, 60):02d}",
            lambda: f"{_pick(rng, '$€£')}{r(1, 9999)}.{d(2)}",
            lambda: f"{r(1, 999)},{d(3)},{d(3)}",
            lambda: f"{r(1, 999)}.{d(3)},{d(2)}",
            lambda: f"{r(1, 999)} {d(3)} {d(3)}",
            lambda: d(r(1, 9)),
            lambda: d(4),
            lambda: f"{r(1800, 2100)}-{r(1800, 2100)}",
            lambda: f"{d(2)}%",
            lambda: f"{r(1, 100)}.{d(r(1, 9))}",
            lambda: f"https://{_name(rng)}.{_pick(rng, _TLD)}/{w()}/{d(3)}?{_name(rng)}={d(r(1, 9))}",
            lambda: f"http://www.{_name(rng)}.{_pick(rng, _TLD)}/{_name(rng)}-{_name(rng)}.html",
            lambda: f"{w()}.{w()}",
            lambda: f"{_name(rng)}.{_pick(rng, ['py', 'txt', 'html', 'js', 'c', 'jpg'])}",
            lambda: f"{_name(rng)}_{_name(rng)}({_name(rng)})",
            lambda: f"/{_name(rng)}/{_name(rng)}/{_name(rng)}{r(0, 99)}",
            lambda: f"@{w()}",
            lambda: f"{w()} @ {w()}",
            lambda: f"#{w()}{r(0, 99)}",
            lambda: f"{_pick(rng, ['ISBN ', 'ISBN-13: ', 'ISBN: '])}{_pick(rng, ['978', '979'])}{_pick(rng, ['-', ' ', ''])}{d(1)}-{d(r(2, 6))}-{d(r(2, 6))}-{d(1)}",
            lambda: f"{_pick(rng, ['ISSN ', 'no. ', 'pp. '])}{d(4)}-{d(4)}",
            lambda: f"{_pick(rng, ['order ', 'order #', 'invoice ', 'Order No. ', 'ticket ', 'tracking number ', 'article ', 'part no. '])}{_pick(rng, ['', '', _run(rng, _UP, r(1, 4)) + '-'])}{d(r(5, 14))}",
            lambda: f"{_pick(rng, ['commit ', 'sha1 ', 'sha256:', 'md5: ', 'checksum ', 'hash ', 'digest: ', 'revision ', 'tree ', 'blob '])}{hexes(_pick(rng, [7, 12, 32, 40, 40, 64]))}",
            lambda: f"{_pick(rng, ['', '', 'uuid ', 'id '])}{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
            lambda: f"doi:10.{d(4)}/{_run(rng, _LOW + _DIGIT + '.', r(5, 20))}",
            lambda: f"{_pick(rng, _KEYS)}{_pick(rng, [' of ', ' and ', ' for the ', ', ', '. '])}{w()}",
            lambda: f'{_name(rng)}{_pick(rng, _AFTER_KEY)}"{w()}"',
            lambda: f"{_name(rng)} = {d(r(1, 7))}",
            lambda: f'"{w()} {w()}"',
            lambda: f"({r(0, 9999)})",
            lambda: f"[{r(0, 200)}]",
            lambda: f"{d(3)}-{d(2)}",
            lambda: f"{r(1, 30)}-{r(1, 30)}",
            lambda: f"{_run(rng, _UP, r(2, 6))}-{d(r(1, 5))}",
            lambda: f"{_run(rng, _UP, r(1, 4))} {_run(rng, _UP, r(1, 4))}-{_run(rng, _UP, 2)} {r(1, 9)}.{r(0, 9)}",
            lambda: "".join(w() for _ in range(6)),
            lambda: _pick(rng, string.punctuation) * r(2, 24),
            lambda: _run(rng, string.punctuation, r(2, 6)),
            lambda: w() + _pick(rng, string.punctuation) * r(1, 4),
            lambda: _other_word(rng),
        ],
    )()


def sample(rng: np.random.Generator, n: int, length: int = 160, data_share: float = 0.12) -> list[tuple[bytes, bytes]]:
    out = []
    for _ in range(n):
        text, label = bytearray(), bytearray()

        def add(s: str, kind: int):
            raw = s.encode()
            text.extend(raw)
            label.extend(bytes([kind]) * len(raw))

        share, upper = data_share * rng.choice([0, 0, 1, 2]), rng.random() < 0.06
        alike = rng.choice([0.03, 0.15, 0.4])
        other = rng.random() < 0.08
        end = _pick(rng, _END) if rng.random() < 0.15 else None
        litter = rng.choice([0.1, 0.4, 0.8]) if rng.random() < 0.15 else 0  # marks that stick to words, as in badly converted text
        while len(text) < 3 * length:
            u = rng.random()
            if u < share:
                kind = int(rng.choice(6, p=[0.17, 0.19, 0.25, 0.17, 0.14, 0.08])) + 1
                if kind >= 5:
                    before, value, after = (secret if kind == 5 else official)(rng)
                    add(before, 0)
                    add(value, kind)
                    add(after, 0)
                else:
                    left, right = _pick(rng, [("", "")] * 6 + [("<", ">"), ("(", ")"), ("[", "]"), ('"', '"')])
                    add(left, 0)
                    add((email, phone, ip, card)[kind - 1](rng), kind)
                    add(right, 0)
            elif u < share + alike:
                add(look_alike(rng), 0)
            else:
                again = word(rng) if rng.random() < 0.004 else ""
                add(f"{again}{_pick(rng, ' .-|')}" * int(rng.integers(3, 20)) if again else _other_word(rng) if other else word(rng), 0)
                if litter and rng.random() < litter:
                    add(_pick(rng, _END).strip() + _pick(rng, string.punctuation) * int(rng.integers(1, 6)), 0)
            add(end or _pick(rng, _END), 0)
        at = int(rng.integers(0, 2 * length)) if rng.random() < 0.8 else 0
        piece = bytes(text[at : at + length])
        out.append((piece.upper() if upper else piece, bytes(label[at : at + length])))
    return out
