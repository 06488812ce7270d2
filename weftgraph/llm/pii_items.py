"""Made-up items for fitting the classifier of personal data: each is (kind or None, what stands before it, the item)."""

from __future__ import annotations

import base64
import random

# Names and words of the made-up items, and what may stand before them.
_NAMES = ("anna", "jonas", "maria", "lee", "omar", "ines", "petra", "sam")
_HOSTS = ("mail", "example", "post", "acme", "inbox")
_ENDS = ("com", "org", "net", "de", "fr", "es")
_LEADS = {
    "email": ("mail ", "e-mail: ", "contact ", "write to ", ""),
    "phone": ("call ", "tel. ", "phone: ", "fax ", "mobile "),
    "card": ("card ", "visa: ", "paid with ", ""),
    "ip": ("host ", "ip ", "from ", ""),
}
_SECRETS = ("token", "api_key", "secret", "password", "auth_token", "access-key")
_PLAIN = ("title", "name", "page", "file", "section")


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))


def _card(rng: random.Random, valid: bool) -> str:
    body = "4" + _digits(rng, 14)
    total = sum(n - 9 * (n > 9) for i, c in enumerate(reversed(body)) for n in [int(c) * (2 - i % 2)])
    return body + str((-total + (0 if valid else rng.randrange(1, 10))) % 10)


def _grouped(digits: str, gap: str) -> str:
    return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _personal(rng: random.Random, kind: str) -> tuple[str, str]:
    lead = rng.choice(_LEADS[kind]) if kind in _LEADS else ""
    if kind == "email":
        user, host, end = rng.choice(_NAMES) + rng.choice(("", ".", "_")) + rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_ENDS)
        return lead, rng.choice((f"{user} [at] {host}.{end}", f"{user}(at){host}.{end}", f"{user} at {host} dot {end}", f"{user}[at]{host}.{end}"))
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return lead, rng.choice((f"({a}) {b}-{c}", f"0{a} {b}{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}"))
    if kind == "card":
        return lead, _grouped(_card(rng, True), rng.choice((".", "/", "  ", " -")))
    if kind == "ip":
        four = [str(rng.randrange(256)) for _ in range(4)]
        six = [f"{rng.randrange(1, 1 << 16):x}" for _ in range(8)]
        return lead, rng.choice(("[.]".join(four), "(.)".join(four), ":".join(six), "::".join((":".join(six[:3]), ":".join(six[3:5])))))
    value = rng.choice((f"{rng.getrandbits(160):040x}", f"{rng.getrandbits(128):032x}", base64.b64encode(rng.randbytes(rng.randrange(15, 40))).decode().rstrip("=")))
    return f"{rng.choice(_SECRETS)}{rng.choice((' = ', '=', ': '))}{rng.choice(('', chr(34), chr(39)))}", value


def _harmless(rng: random.Random) -> tuple[str, str]:
    y, m, d = rng.randrange(1900, 2030), rng.randrange(1, 13), rng.randrange(1, 29)
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice((
        ("", f"{y}-{m:02}-{d:02} {m:02}"), ("date ", f"{d:02}/{m:02}/{y} {m:02}"), ("no. ", _digits(rng, rng.randrange(7, 13))), ("order ", f"{_digits(rng, 5)}-{c}"),
        ("isbn ", f"978-{d % 10}-{_digits(rng, 2)}-{_digits(rng, 6)}-{m % 10}"), ("version ", f"{m}.{d}.{b}.{c}.1"), ("", _card(rng, False)), ("total ", f"{a} {b} {c}"),
        ("", f"{a} {b} {c}"), ("ratio ", f"{m}:{d}:{a}"), ("", f"{m:02}:{d:02}:{m:02}"), ("", f"@{rng.choice(_NAMES)}"), ("", f"{rng.choice(_NAMES)} at {rng.choice(_HOSTS)}"),
        (f"{rng.choice(_PLAIN)} = ", "".join(rng.choice("aeinrst") for _ in range(rng.randrange(16, 30)))), (f"{rng.choice(_PLAIN)}: ", _digits(rng, rng.randrange(16, 25))),
        (f"{rng.choice(_PLAIN)}: ", "-".join(rng.choice(_HOSTS) for _ in range(4))), ("sum ", _grouped(_card(rng, False), rng.choice((".", "  ")))),
    ))


def _unseen(rng: random.Random, kind: str) -> tuple[str, str]:
    """Forms that no example for fitting has; some are beyond every candidate generator."""
    lead = rng.choice(_LEADS[kind]) if kind in _LEADS else ""
    if kind == "email":
        user, host, end = rng.choice(_NAMES) + rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_ENDS)
        return lead, rng.choice((f"{user}@{host},{end}", f"{user} [at] {host} [dot] {end}", f"{user}(at){host}(dot){end}", f"{user} at {host} dot co dot {end}"))
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return lead, rng.choice((f"({a}){b}{c}", f"{a} {b}-{c}", f"00{a} {b} {c}", f"{a}/{b}-{c}"))
    if kind == "card":
        return lead, _grouped(_card(rng, True), rng.choice(("- ", "./", "--", "_")))
    if kind == "ip":
        a, b, c, d = (rng.randrange(256) for _ in range(4))
        return lead, rng.choice((f"{a}[.]{b}[.]{c}(.){d}", f"{a}.{b}.{c}[.]{d}", f"fe80::{a:x}:{b:x}:{c:x}:{d:x}", f"{a} . {b} . {c} . {d}"))
    value = rng.choice((f"sk-{rng.getrandbits(120):030x}", f"{rng.getrandbits(64):016X}", base64.urlsafe_b64encode(rng.randbytes(30)).decode()))
    return f"{rng.choice(('client_secret', 'passwd', 'Authorization'))}{rng.choice((':', ' := ', '='))}", value


def item(rng: random.Random, unseen: bool = False) -> tuple[str | None, str, str]:
    """A made-up item of personal data or a secret, or (kind None) a harmless look-alike."""
    if rng.random() < 0.5:
        return None, *_harmless(rng)
    kind = rng.choice((*_LEADS, "secret"))
    return kind, *(_unseen if unseen else _personal)(rng, kind)
