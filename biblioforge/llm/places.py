"""Readers of freely typed countries and institutions for the mapping to canonical lists."""

from __future__ import annotations

import re

from biblioforge.llm import names
from biblioforge.llm.canonical import Reader

#: Other names of countries, by their ISO 3166-1 alpha-3 code.
OTHER_NAMES = {
    "ARG": "Argentine Republic", "AUS": "Commonwealth of Australia", "AUT": "Österreich|Autriche", "BEL": "België|Belgique|Belgien", "BRA": "Brasil|Federative Republic of Brazil",
    "CAN": "Kanada", "CHE": "Schweiz|Suisse|Svizzera|Swiss Confederation", "CHL": "", "CHN": "PRC|P.R. China|PR China|People's Republic of China|Mainland China|Zhongguo|Chine", "COL": "",
    "CZE": "Czech Republic|Česko|Česká republika", "DEU": "Deutschland|Allemagne|Federal Republic of Germany|Fed. Rep. of Germany|Alemania|BRD", "DNK": "Danmark",
    "EGY": "Misr|Arab Republic of Egypt", "ESP": "España|Espana|Kingdom of Spain|Espagne", "EST": "Eesti", "FIN": "Suomi", "FRA": "French Republic|République française",
    "GBR": "UK|U.K.|Great Britain|Britain|England|Scotland|Wales|Northern Ireland|United Kingdom of Great Britain and Northern Ireland",
    "GIN": "Guinée", "GRC": "Hellas|Ellada|Hellenic Republic", "HUN": "Magyarország", "IND": "Bharat", "IRL": "Éire|Eire|Republic of Ireland", "IRN": "Iran|Islamic Republic of Iran|Persia",
    "ISR": "State of Israel", "ITA": "Italia|Italian Republic", "JPN": "Nippon|Nihon", "KEN": "", "KOR": "Korea|South Korea|Republic of Korea|Rep. of Korea|ROK", "LUX": "Luxemburg|Grand Duchy of Luxembourg",
    "MEX": "México|United Mexican States", "MYS": "", "NER": "", "NGA": "Federal Republic of Nigeria", "NLD": "Nederland|Holland|The Netherlands", "NOR": "Norge|Noreg", "NZL": "Aotearoa",
    "PAK": "Islamic Republic of Pakistan", "PNG": "", "POL": "Polska", "PRT": "Portuguese Republic", "RUS": "Russia|Rossiya|Россия", "SAU": "KSA|Kingdom of Saudi Arabia", "SGP": "",
    "SRB": "Srbija", "SVN": "Slovenija", "SVK": "Slovensko|Slovak Republic", "SWE": "Sverige", "THA": "Siam", "TUR": "Turkey|Turkiye|Republic of Türkiye", "TWN": "Taiwan|Republic of China|ROC|Chinese Taipei",
    "UKR": "Ukraina", "URY": "", "USA": "U.S.A.|U.S.|the States|United States of America|America|Estados Unidos|États-Unis", "VNM": "Vietnam|Việt Nam", "ZAF": "RSA|Republic of South Africa",
}
#: Countries that a slip of one or two letters could take for another one.
LOOKALIKES = (
    "Albania Algeria Angola Armenia Bahrain Belarus Belize Benin Bhutan Bolivia Botswana Bulgaria Burundi Cambodia Chad Comoros Congo Croatia Cuba Cyprus Dominica Ecuador Eritrea "
    "Ethiopia Fiji Gabon Gambia Georgia Ghana Grenada Guatemala Guyana Haiti Honduras Iceland Indonesia Iraq Jamaica Jordan Kiribati Kosovo Kuwait Laos Latvia Lebanon Lesotho Liberia Libya "
    "Lithuania Madagascar Malawi Maldives Mali Malta Mauritania Mauritius Moldova Monaco Mongolia Montenegro Morocco Mozambique Myanmar Namibia Nauru Nepal Nicaragua Oman Palau "
    "Panama Paraguay Peru Philippines Qatar Romania Rwanda Samoa Senegal Seychelles Somalia Sudan Suriname Syria Tajikistan Tanzania Togo Tonga Tunisia Turkmenistan Tuvalu Uganda "
    "Uzbekistan Vanuatu Venezuela Yemen Zambia Zimbabwe Liechtenstein Andorra Antarctica"
).split()
UNLISTED = "-"
_BLOCK, _SEGMENT, _BRACKETS = re.compile(r":\s"), re.compile(r"[,;]|\s[–-]\s"), re.compile(r"\s*\([^)]*\)")
_ACRONYM, _SHORT = re.compile(r"[A-Z][A-Z0-9]{1,5}"), re.compile(r"(?:TU)\s+(\S.*)")


def _plain(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", names.fold(text)).split())


def country_forms(rows: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(form, code) of reference countries (country_3, country_2, country_name)."""
    forms = []
    for three, two, name in rows:
        for form in (name, name.split(",")[0], *OTHER_NAMES.get(three, "").split("|")):
            if _plain(form):
                forms.append((_plain(form), three))
        forms += [("=" + three.lower(), three), ("=" + two.lower(), three)]
    known = {f for f, _ in forms}
    return forms + [(_plain(x), UNLISTED) for x in LOOKALIKES if _plain(x) not in known]


def _country_edits(form: str) -> int:
    return 0 if len(form) < 5 else 2 if len(form) < 10 else 3


def read_country(value: str) -> list[tuple[str, int]]:
    """Readings of a typed country: as it stands, without a code in brackets, as its last part, without the form of state."""
    text = value.strip().rstrip(".").strip()
    readings: list[tuple[str, int]] = []

    def add(part: str) -> None:
        form = _plain(part)
        if not form:
            return
        squeezed = form.replace(" ", "")
        if len(squeezed) in (2, 3):
            readings.append(("=" + squeezed, 0))
        readings.append((form, 0))

    bare, code = re.sub(r"\s*\([^)]*\)\s*$", "", text), re.search(r"\(([A-Za-z]{2,3})\)\s*$", text)
    parts = [text, bare, bare.rsplit(",", 1)[-1]]
    parts += [re.sub(r"(?i)^\s*(the\s+)?((federal|islamic|kingdom|people'?s)\s+)*(rep(ublic)?|kingdom|state|commonwealth)\.?\s+of\s+(the\s+)?", "", p) for p in parts]
    for part in parts:
        add(part)
    exact = list(readings)
    typed = [(f, _country_edits(f)) for f, _ in readings if not f.startswith("=") and _country_edits(f)]
    coded = [("=" + code.group(1).lower(), 0)] if code else []
    return list(dict.fromkeys(exact + coded + typed))


def _form(bag: tuple[str, ...], proper: tuple[str, ...]) -> str:
    return " ".join(bag) + " | " + " ".join(proper)


def institution_forms(rows: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(form, code) of reference institutions (inst_code, institution_name, short_name)."""
    forms = []
    for code, name, short in rows:
        read = names.read(name)
        forms.append((_form(read.bag, read.proper), code))
        if short:
            forms.append(("=" + short, code))
    return forms


def _institution_edits(proper: tuple[str, ...]) -> int:
    n = sum(map(len, proper))
    return 0 if n < 5 else 1 if n < 7 else 2


def institution_reader(codes: frozenset[str]) -> Reader:
    """A reader of affiliations; ``codes``: country codes, which are no acronyms where a country stands."""

    def read(value: str) -> list[tuple[str, int]]:
        text = _BRACKETS.sub("", value) if "(" in value and re.search(r"\w.*\(", value) else value
        blocks = _BLOCK.split(text)
        named: list[tuple[str, int]] = []
        joined: list[tuple[str, int]] = []
        acronyms: list[tuple[str, int]] = []
        for block in blocks:
            segments = [s.strip() for s in _SEGMENT.split(block)]
            segments = [s for s in segments if s]
            named_as = [names.read(s) for s in segments]
            for place, r, q in zip(segments[1:], named_as, named_as[1:]):  # "Institute of Ecology, Place"
                if r.bag and not r.proper and len(q.proper) == 1 and not q.bag and not re.search(r"\d", place):
                    joined.append((_form(r.bag, q.proper), _institution_edits(q.proper)))
            for i, segment in enumerate(segments):
                plain = segment.rstrip(".").strip()
                if _ACRONYM.fullmatch(plain):
                    last = i == len(segments) - 1 and (len(segments) > 1 or len(blocks) > 1)
                    if not last and not (plain in codes and i > 1):
                        acronyms.append(("=" + plain, 0))
                    continue
                short = _SHORT.fullmatch(plain)
                typed = ("Technical University " + short.group(1)) if short else segment
                r = names.read(typed) if short else named_as[i]
                if r.bag and r.proper:
                    # With several unknown words a segment is no mistyped name of one place, unless all but one are mistyped lexicon words.
                    named.append((_form(r.bag, r.proper), _institution_edits(r.proper) if len(r.proper) == 1 else 0))
                    if len(r.proper) > 1:
                        r = names.read(typed, frozenset(), True)
                        named.append((_form(r.bag, r.proper), _institution_edits(r.proper)))
        named = list(dict.fromkeys(named + joined))
        return [(f, 0) for f, _ in named] + [n for n in named if n[1]] + acronyms

    return read
