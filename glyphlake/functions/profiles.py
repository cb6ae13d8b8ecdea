"""Tables of a script: alphabet, confusable letters, and what cleaning maps where. The engine is not tied to one alphabet."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    name: str
    letters: str
    capitals: str
    script: str
    diacritics: tuple[tuple[str, str], ...]
    homoglyphs: tuple[tuple[str, str], ...]
    punctuation: str
    shifts: tuple[tuple[str, str], ...]
    replacements: tuple[tuple[str, str], ...] = ()
    unwanted: str = field(init=False)

    def __post_init__(self):
        own = sorted(map(ord, {*self.letters, *self.letters.upper()}))
        ranges = [(a, a) for a in own[:1]]
        for a in own[1:]:
            ranges[-1:] = [(ranges[-1][0], a)] if a == ranges[-1][1] + 1 else [ranges[-1], (a, a)]
        letters = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)  # few ranges, as each is asked for each letter
        # Printable ASCII is never meant and asked first, as most characters are just that.
        object.__setattr__(self, "unwanted", rf"[[^\x20-\x7E]&&[\p{{C}}\p{{L}}]&&[^A-Za-z{letters}]]+")

    def both_ways(self, pairs: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
        return sorted({*pairs, *((b, a) for a, b in pairs)})


# Fixed values of the Macedonian profile.
MACEDONIAN = Profile(
    name="macedonian",
    letters="абвгдѓежзѕијклљмнњопрстќуфхцчџш",
    capitals="A-ZА-ЯЁІЇЄҐЃЅЈЉЊЌЏ",
    script=r"Ѐ-ӿ",
    diacritics=(("Г", "Ѓ"), ("К", "Ќ"), ("Л", "Љ"), ("Н", "Њ"), ("г", "ѓ"), ("к", "ќ"), ("л", "љ"), ("н", "њ")),
    homoglyphs=(("А", "A"), ("а", "a"), ("В", "B"), ("Е", "E"), ("е", "e"), ("К", "K"), ("М", "M"), ("Н", "H"), ("О", "O"), ("о", "o"), ("Р", "P"), ("С", "C"), ("с", "c"), ("Т", "T"), ("Х", "X"), ("У", "Y"), ("Ѕ", "S"), ("ѕ", "s")),
    punctuation=".,!?;:'\"„“”()-—[]{}",
    shifts=((".", ","), (",", "."), (":", ";"), (";", ":"), ("„", '"'), ("“", '"'), ('"', "„"), ("'", '"'), ("—", "-"), ("-", "—")),
    replacements=(
        ("Щ", "Ш"), ("щ", "ш"), ("Ю", "Ју"), ("ю", "ју"), ("Я", "Ја"), ("я", "ја"), ("Ї", "Ји"), ("ї", "ји"),
        ("й", "ј"), ("Й", "Ј"), ("ё", "о"), ("Ё", "О"), ("ы", "и"), ("Ы", "И"), ("э", "е"), ("Э", "Е"), ("ъ", ""), ("Ъ", ""), ("ь", ""), ("Ь", ""),
        ("і", "и"), ("І", "И"), ("є", "е"), ("Є", "Е"), ("ґ", "г"), ("Ґ", "Г"), ("ѣ", "е"), ("Ѣ", "Е"), ("ѳ", "ф"), ("Ѳ", "Ф"),
        ("ѵ", "и"), ("Ѵ", "И"), ("ѡ", "о"), ("Ѡ", "О"), ("ѧ", "а"), ("Ѧ", "А"), ("ѫ", "у"), ("Ѫ", "У"), ("ѯ", "кс"), ("Ѯ", "Кс"),
    ),
)

#: A profile for the Latin texts of the test tables.
LATIN = Profile(
    name="latin",
    letters="abcdefghijklmnopqrstuvwxyzäöüßéèêçñóíá",
    capitals="A-ZÀ-ÖØ-Þ",
    script="A-Za-zÀ-ÿ",
    diacritics=(("é", "e"), ("è", "e"), ("ü", "u"), ("ö", "o"), ("ä", "a"), ("ñ", "n"), ("ó", "o"), ("ç", "c")),
    homoglyphs=(("o", "0"), ("l", "1"), ("i", "j"), ("e", "c"), ("h", "b"), ("n", "u"), ("t", "f"), ("r", "v")),
    punctuation=".,!?;:'\"()-[]{}",
    shifts=((".", ","), (",", "."), (":", ";"), (";", ":")),
)

PROFILES = {p.name: p for p in (MACEDONIAN, LATIN)}
