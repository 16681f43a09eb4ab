"""Training windows for the tagger: words of the corpus with spans of personal data set among them, plain, spaced, obfuscated or broken, and with what only looks like one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ENDINGS = ("com", "org", "net", "de", "fr", "es", "io", "info", "example", "co.uk")


def _word(rng: Random, least: int = 2, most: int = 9) -> str:
    return "".join(rng.choices(LETTERS, k=rng.randint(least, most)))


def _digits(rng: Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _name(rng: Random) -> str:
    name = rng.choice(["", _word(rng) + rng.choice("._-")]) + _word(rng) + rng.choice(["", _digits(rng, rng.randint(1, 3))])
    return name.title() if rng.random() < 0.15 else name


def _card(rng: Random) -> list[str]:
    """Four groups of four digits that pass the checksum."""
    body = [int(c) for c in _digits(rng, 15)]
    total = sum(d if i % 2 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(body))
    number = "".join(map(str, body)) + str(-total % 10)
    return [number[i : i + 4] for i in range(0, 16, 4)]


def _address(at: str, dot: str) -> Callable[[Random], str]:
    return lambda rng: _name(rng) + at + rng.choice(["", "mail.", _word(rng) + "."]).replace(".", dot) + _word(rng) + dot + rng.choice(ENDINGS[:-1])


def _ip(dot: str) -> Callable[[Random], str]:
    return lambda rng: dot.join(str(rng.randint(0, 255)) for _ in range(4))


def _grouped(gap: str) -> Callable[[Random], str]:
    return lambda rng: gap.join(_card(rng))


def _broken(rng: Random) -> str:
    groups = _card(rng)
    at = rng.randint(1, 3)
    return " ".join(groups[:at]) + "\n" + " ".join(groups[at:])


def _call(shape: str) -> Callable[[Random], str]:
    """# is a digit, c a country code."""
    return lambda rng: "".join(_digits(rng, 1) if x == "#" else str(rng.randint(1, 99)) if x == "c" else x for x in shape)


#: Forms by kind (email, ip, card, phone). KNOWN ones train the tagger; HELD ones are kept for its tests.
KNOWN: tuple[list[Callable[[Random], str]], ...] = (
    [_address("@", "."), _address(" @ ", "."), _address("(at)", "."), _address(" [at] ", " [dot] "), _address("@", " . "), _address("@\n", "."), _address("{at}", "."), _address(" (at) ", " (dot) ")],
    [_ip("."), _ip(" . "), _ip("[.]"), _ip(". "), _ip("[dot]")],
    [_grouped(""), _grouped(" "), _grouped("-"), _grouped("."), _grouped("  "), _grouped(" - "), _broken],
    [_call(x) for x in ("+c (###) ###-####", "+c ### ### ####", "(###) ###-####", "###-###-####", "###.###.####", "00c ### ### ####", "+c/###/###/####", "+c ###\n### ####", "0### ######", "+c-###-#######", "(0##) #### ####")],
)
HELD: tuple[list[Callable[[Random], str]], ...] = (
    [_address(" (at) ", "."), _address("[at]", "[.]"), _address(" {at} ", " {dot} "), _address(" @\n", ".")],
    [_ip("(.)"), _ip(" [.] "), _ip(" .")],
    [_grouped("/"), _grouped("_"), _grouped(" . ")],
    [_call(x) for x in ("(###)###-####", "### ### ####", "+c/### ### ####", "00c-###-###-####", "(###)\n###-####", "###/###-####")],
)
#: What is no personal data, whatever it looks like.
NONE: list[Callable[[Random], str]] = [
    lambda rng: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
    lambda rng: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2099)}",
    lambda rng: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1900, 2099)}",
    lambda rng: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
    lambda rng: f"{rng.randint(1900, 2000)}-{rng.randint(2001, 2099)}",
    lambda rng: f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}",
    lambda rng: ".".join(str(rng.randint(0, 20)) for _ in range(rng.choice([2, 3, 5, 6]))),
    lambda rng: f"{rng.randint(1, 999)},{_digits(rng, 3)},{_digits(rng, 3)}.{_digits(rng, 2)}",
    lambda rng: f"{rng.randint(0, 99)}.{_digits(rng, rng.randint(1, 6))}",
    lambda rng: _digits(rng, rng.randint(1, 12)),
    lambda rng: "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 32, 40]))),
    lambda rng: f"978-{_digits(rng, 1)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{_digits(rng, 1)}",
    lambda rng: f"{_word(rng, 2, 3).upper()}-{_digits(rng, 5)}-{_digits(rng, 4)}",
    lambda rng: f"@{_word(rng)}",
    lambda rng: f"{_digits(rng, 1)} @ {_digits(rng, 2)}",
    lambda rng: f"{_word(rng)}[{_digits(rng, 1)}] = {_word(rng)}({_digits(rng, 2)})",
    lambda rng: f"({_word(rng)} {_digits(rng, 2)}, {_digits(rng, 3)})",
    lambda rng: f"(at {_word(rng)} {_digits(rng, 2)})",
    lambda rng: f"[{_digits(rng, 1)}], [{_digits(rng, 2)}]",
    lambda rng: f"{_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 2)}",
]


def composed(rng: Random, texts: list[str], forms: tuple, none: float = 0.35) -> tuple[str, list[tuple[int, int, int]]]:
    """A stretch of words of one of the texts with a span, or with what is none, in its midst: the text and its spans (kind, start, end)."""
    text = rng.choice(texts) if texts else ""
    at = rng.randint(0, max(0, len(text) - 160))
    left, _, right = text[at : at + 160].partition(" ")
    words = (right if right else left).split(" ")
    cut = rng.randint(0, len(words))
    before, after = " ".join(words[:cut]), " ".join(words[cut:])
    kind = -1 if rng.random() < none else rng.randrange(len(forms))
    made = (rng.choice(NONE) if kind < 0 else rng.choice(forms[kind]))(rng)
    gap, close = rng.choice([" ", " ", " ", "\n", ": ", " (", "\t"]), rng.choice([" ", " ", ". ", ", ", "\n", ") ", "; "])
    start = len(before) + len(gap)
    return before + gap + made + close + after, [] if kind < 0 else [(kind, start, start + len(made))]


def examples(texts: list[str], n: int, window: int, forms: tuple = KNOWN, seed: int = 17) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """n windows of composed texts with their spans. A window may cut a span, as it does in decoding: a start below 0 lies before the window."""
    rng = Random(seed)
    for _ in range(n):
        text, spans = composed(rng, texts, forms)
        middle = (spans[0][1] + spans[0][2]) // 2 if spans else rng.randint(0, len(text))
        start = max(0, min(middle - window // 2 + rng.randint(-window // 3, window // 3), len(text) - window))
        yield text[start : start + window].ljust(window, "\x00"), [(k, s - start, min(window, e - start)) for k, s, e in spans if s - start < window and e > start]
