"""A small labelled table for the personal-data model, made by rule from sentence frames and written forms.

In forms, ``#`` is a digit, ``&`` a number up to 255, ``%`` a made-up word.
Card numbers get the check digit that makes them valid.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "ip", "card", "phone")

FORMS = {
    "email": (
        "%@%.com", "%.%@%.org", "%.##@%#.%.com", "%_%@%-%.net", "%##@%.co.%", "% (at) % (dot) com", "% at % dot org", "%[at]%.net", "% AT % DOT de",
        "%.%(at)%.fr", "% [at] % [dot] es", "%.% at % dot com", "% (at) %.org", "% @ %.com", "%##(at)%(dot)com", "% {at} % {dot} net",
    ),
    "ip": ("&.&.&.&", "& . & . & . &", "&.&.&.&", "&(.)&(.)&(.)&", "&[.]&[.]&[.]&", "& dot & dot & dot &"),
    "card": (
        "################", "#### #### #### ####", "####-####-####-####", "####.####.####.####", "#### / #### / #### / ####", "####/####/####/####",
        "#### ###### #####", "####  ####  ####  ####", "#### - #### - #### - ####", "####_####_####_####", "#############",
    ),
    "phone": (
        "+# (###) ###-####", "+## ### #######", "+##-###-###-####", "(###) ###-####", "(###) ### ####", "(###)###-####", "###-###-####", "###.###.####",
        "# (###) ###-####", "00## ### #######", "0### / #######", "0## #### ####", "0###-######", "(0##) ### ## ##", "0# ## ## ## ##", "+##/###/#######",
    ),
}

FRAMES = {
    "email": ("write to {} today", "e-mail: {}", "mail me at {}.", "contact {} for %", "Kontakt: {}", "mon adresse {} est %", "correo {} de %"),
    "ip": ("the host {} was down", "from {} port ##", "IP {}", "ip address: {}", "server {} %", "ping {}", "Rechner {} %"),
    "card": ("card {} was charged", "Visa {}", "pay with {} please", "credit card number: {}", "Karte {}", "carte {} %", "tarjeta {} %"),
    "phone": ("call {} now", "Tel. {}", "phone: {}", "call me on {} after ##", "Fax {}, %", "Telefon {}", "mobile {}", "tél : {}", "ring {}."),
    None: ("% % {} % %", "%, % % {} % % %.", "{}", "% % {}", "{} % %, %", "%*** %*** {}*** %***", "%, {}.", "%. {} % %.", '% "{}" %', "% ({}) % %", "%&&& {}&&& %", "{}### %"),
}

#: Texts without personal data that look a little like it.
OTHERS = (
    "% % % % %, % % %.", "%. % % %, %: % % %.", "% ####-##-## %", "##.##.#### %", "% ##/##/####", "%, ##:##:## %", "% v#.#.# %", "version #.##.### of %", "% §#.#.#",
    "% #,###.## %", "$ ###,### % %", "% ### ### ### %", "ISBN 978-#-##-######-# %", "% ###-##-#### %", "% (####) %", "% (###) % %", "(#) % % (##) %", "% ####-#### %",
    "% ##-## %", "# x # x #", "% ####### %", "% #### % #### %", "#.# % #.## %", "%, ## %, ### %, #### %", "% # # # # %", "%. ##. % ###. %", "% at % % %", "% at the % of %.",
    "look at % dot %", "% dot % dot %", "@% % @%", "% @ % %", "www.%.com/%/##", "http://%.org/%?%=##", "%.com % %.org", "% at %. % %", "meet % at ## %", "% at ##:## %",
    'token = "%##%#%###%%%#%#"', "%#%##%%###%", "%## %## %##", "#% ##% ###%", "%%%@%", "% ### % ## % %", "% ###.###.### %", "% ##.###.### %", "%-%-% %_% %.%", "%!! %!! %!!",
    "%*** %&&& %### %$$$ %%%%", "# ## ### ####", "####", "##", "% (at) %", "% (at the %) %", "% [#] % [##]", "%/% ##/## %", "+# % +## %", "%: ###### %", "%*** at*** %$$$ the!! %", "%. At % %", "% at. %", "% at % for at to %.", "%$$$ at!! %.*** %", "% ##### %", "%'% %'% %", "page ### of ###",
)


def _luhn(digits: list[int]) -> bool:
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _filled(form: str, draw: random.Random) -> str:
    syllables = "th er on an re he in ed nd ha at en es of or ti is hi as te ing le ou de la que ein sch ue ó é ñ".split()

    def one(mark: str) -> str:
        if mark == "#":
            return str(draw.randrange(10))
        if mark == "&":
            return str(draw.randrange(256))
        word = "".join(draw.choice(syllables) for _ in range(draw.choice((1, 2, 2, 3, 4))))
        return draw.choice((word, word, word, word.capitalize(), word.upper() if draw.random() < 0.2 else word))

    return re.sub("[#&%]", lambda x: one(x.group()), form)


def _card(form: str, draw: random.Random) -> str:
    text = _filled(form, draw)
    last = max(i for i, c in enumerate(text) if c.isdigit())
    return next(x for x in (text[:last] + str(d) + text[last + 1 :] for d in range(10)) if _luhn([int(c) for c in x if c.isdigit()]))


def examples(rounds: int = 3, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with their spans ``(kind, start, end)``, in code points; each form and each other text comes ``rounds`` times."""
    draw = random.Random(seed)
    rows: list[tuple[str, list[tuple[str, int, int]]]] = []
    for _ in range(rounds):
        for kind in KINDS:
            for form in FORMS[kind]:
                for frames in (FRAMES[kind], FRAMES[None]):
                    before, after = (_filled(x, draw) for x in draw.choice(frames).split("{}"))
                    value = _card(form, draw) if kind == "card" else _filled(form, draw)
                    rows.append((before + value + after, [(kind, len(before), len(before) + len(value))]))
        rows += [(_filled(x, draw), []) for x in OTHERS]
    return rows
