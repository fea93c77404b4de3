"""The pseudonym rules in plain Python."""

import hashlib
import hmac
import re
from datetime import date, timedelta

from veritide.llm import pii


def draw(tweak, r, v, bits=256):
    return hashlib.new(f"sha{bits}", f"{tweak}:{r}:{v}".encode()).hexdigest()


def plain_numbers(a, b, mods, tweak):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + int(draw(tweak, r, b)[:15], 16) % mods[0]) % mods[0]
        else:
            b = (b + int(draw(tweak, r, a)[:15], 16) % mods[1]) % mods[1]
    return a, b


def plain_text(s, tweak, hexa=False):
    def shift(t, stream):
        out = ""
        for i, c in enumerate(t):
            by = int(stream[2 * (i % 64) : 2 * (i % 64) + 2], 16)
            for alphabet in ["0123456789abcdef"] if hexa else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]:
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + by) % len(alphabet)]
                    break
            out += c
        return out

    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = shift(a, draw(tweak, r, b, 512))
        else:
            b = shift(b, draw(tweak, r, a, 512))
    return a + b


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10


def cased(template, text):
    return "".join(b.upper() if "A" <= a <= "Z" else b for a, b in zip(template, text, strict=True))


def filled(template, chars, of="[0-9]"):
    it = iter(chars)
    return re.sub(of, lambda _: next(it), template)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def card(m):
    groups = re.findall("[0-9]+[ -]?", m)
    runs = [re.sub("[ -]$", "", "".join(groups[a:b])) for a in range(len(groups)) for b in range(a + 1, len(groups) + 1)]
    good = [w for w in runs if 13 <= len(re.sub(r"\D", "", w)) <= 19 and luhn(re.sub(r"\D", "", w)) == 0]
    return max(good, key=len, default=None)


def plain(m, key):
    t = lambda k: hmac.new(key.encode(), k.encode(), hashlib.sha256).hexdigest()
    full = lambda k: re.fullmatch(pii.PATTERNS[k], m)
    if full("email"):
        stem, tld = m.rsplit(".", 1)
        return cased(stem, plain_text(stem.lower(), t("email"))) + "." + tld
    if full("hex"):
        return plain_text(m, t("hex"), True)
    if full("key"):
        p = re.match("AKIA|ASIA|gh[a-z]_|sk-", m)[0]
        return p + plain_text(m[len(p) :], t("key"))
    if full("iban"):
        v = m.replace(" ", "")
        if mod97(v[4:] + v[:4]) != 1:
            return m
        new = plain_text(v[4:], f"{t('iban')}:{v[:2]}")
        return filled(m, f"{v[:2]}{98 - mod97(new + v[:2] + '00'):02}{new}", "[0-9A-Z]")
    if full("phone"):
        d = re.sub(r"\D", "", m)
        c = re.match(pii.COUNTRY, d)[0] if m[0] == "+" else "1"
        new = plain_text(d[len(c) :] if m[0] == "+" else d, f"{t('phone')}:{c}")
        return filled(m, c + new if m[0] == "+" else new)
    if full("ip6"):
        return cased(m, filled(m, plain_text(m.lower().replace(":", ""), t("ip6"), True), "[0-9A-Fa-f]"))
    if full("ip"):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        a, b = plain_numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), t("ip"))
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if full("ssn"):
        if m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[7:] == "0000":
            return m
        a, b = plain_numbers(int(m[:3]) - (2 if m[:3] > "666" else 1), (int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, (898, 99 * 9999), t("ssn"))
        return f"{a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if full("date"):
        x = [int(v) for v in re.split("[-/.]", m)]
        orders = [(0, 1, 2)] if m[4] == "-" else [(2, 1, 0), (2, 0, 1)]
        for k, o in enumerate(orders):
            try:
                day = (date(*(x[i] for i in o)) - date(1900, 3, 1)).days
            except ValueError:
                continue
            if not 0 <= day < 17 * 4297:
                return m
            a, b = plain_numbers(*divmod(day, 4297), pii.DAYS, t("date"))
            new = date(1900, 3, 1) + timedelta(a * 4297 + b)
            if m[4] == "-":
                return new.isoformat()
            two = (new.day, new.month) if k == 0 else (new.month, new.day)
            w = "02" if len(m) == 10 else ""
            sep = "/" if "/" in m else "."
            return f"{two[0]:{w}}{sep}{two[1]:{w}}{sep}{new.year}"
        return m
    w = m if luhn(re.sub(r"\D", "", m)) == 0 else card(m)
    if w is None:
        return m
    d = re.sub(r"\D", "", w)
    p = d[0] + plain_text(d[1:-1], t("card"))
    return m.replace(w, filled(w, p + str(-luhn(p + "0") % 10)))


def rewrite_with(key, text):
    return None if text is None else re.sub(pii.ANY, lambda m: plain(m[0], key), text)
