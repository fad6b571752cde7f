"""Personal information inside free text.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs and
their spelled-out forms, plus signs, cue words for telephone and identity
numbers, brackets and double zeros, street words, titles and other words before
a name, and the names of the gazetteer.  At each anchor a
deterministic local parser expands to both sides and validates what it found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Given names and family names of the gazetteer.
GIVEN_NAMES = (
    "Amparo Anselm Briseis Chidera Corwen Darvo Dunja Elspeth Evander Fenja Florine Gaston Hartmut Ilsabet Jorun "
    "Lubomar Maelis Mirela Nerea Okan Oswin Perrine Quenna Rurik Sandrel Solveig Takeru Tibalt Vidkun Ysolde"
).split()
FAMILY_NAMES = (
    "Achterveld Beaumarchand Brackwell Cloverdyke Corrigdale Drummelow Duskwater Eszterhaz Falkenried Fjellmark "
    "Grunewohl Harkaway Holmgaard Iturbeda Jansholt Kestlewick Lindqvarn Lorquin Maravelle Moncrisse Nakaridani "
    "Ostrovane Oyelaran Perrinot Pfefferling Quenthart Quillinan Rosmarek Sotomarez Strandhove Tarrowby Tolvanek "
    "Uxbrigg Vantongeren Villamontes Wexcombe Wintersole Yarborne Zielbrand Zupanovek"
).split()
# Common given and family names of the five languages' countries.
COMMON_GIVEN = (
    "Adam Adrian Alejandro Alexander Alice Amanda Amelie Ana Andrea Andrew Angela Anna Anne Antoine Antonio Barbara Benjamin Carlos Carmen Caroline Catherine Charles Charlotte Chloé Christian "
    "Christine Christopher Clara Claire Daniel David Diego Edward Elena Elizabeth Emily Emma Eva Fernando Florian Francisco Frank Franziska Frédéric Gabriel George Georg Hannah Hans Harry Helen Henry "
    "Isabel Isabelle Jack Jacob Jakob James Jan Jane Javier Jean Jennifer Jessica Johannes John Jonas Jorge José Joseph Juan Julia Julien Jürgen Karen Karl Katharina Kevin Klaus Laura Lena Leon Linda "
    "Lisa Louis Luca Lucas Lucía Luis Lukas Manuel Marc Margaret María Maria Marie Marta Martin Mary Matthew Max Maximilian Michael Miguel Mohammed Monika Nathalie Nicholas Nicolas Nina Olivia Pablo "
    "Patricia Patrick Paul Pedro Peter Philipp Philippe Pierre Rachel Rafael Raúl Richard Robert Roberto Samuel Sandra Sarah Sebastian Sergio Simon Sofia Sophie Stefan Stephen Susan Susanne Theresa "
    "Thomas Tim Ursula Valentina Victoria William Wolfgang"
).split()
COMMON_FAMILY = (
    "Adams Allen Álvarez Anderson Bailey Baker Bauer Becker Bell Bennett Bernard Bertrand Braun Brown Campbell Carter Castro Clark Collins Cook Cooper Cox Davies Davis Delgado Díaz Dubois Dupont "
    "Durand Edwards Evans Fernández Fischer Flores Fournier Garcia García Gómez González Gonzalez Gray Green Gutiérrez Hall Harris Hartmann Hernández Hernandez Herrera Hill Hoffmann Howard Hughes "
    "Jackson Jenkins Jiménez Johnson Jones Kelly Klein Koch Krüger Lambert Lange Laurent Lefebvre Leroy Lewis Lopez López Martin Martín Martínez Martinez Meyer Michel Miller Mitchell Moore Morales "
    "Moreau Moreno Morgan Morris Müller Muñoz Murphy Navarro Nelson Neumann Ortiz Parker Peterson Petit Phillips Perez Pérez Ramírez Ramos Reed Richter Rivera Roberts Robinson Rodríguez Rodriguez Rogers "
    "Romero Rousseau Roux Ruiz Sánchez Sanchez Sanders Schäfer Schmidt Schmitt Schneider Schröder Schulz Schwarz Scott Simmons Smith Stewart Taylor Thomas Thompson Torres Turner Vargas Vázquez "
    "Vincent Wagner Walker Ward Watson Weber Werner White Williams Wilson Wright Wolf Zimmermann"
).split()
# Words that announce a telephone number.
PHONE_CUES = (
    "phone", "Phone", "number", "Call", "call", "Ring me on", "WhatsApp", "Tel", "tel", "Tél", "Erreichbar unter", "Appelez le",
    "móvil es", "전화", "Telefon", "mobile", "Mobile", "Handy", "Fax", "fax", "teléfono", "Llama al", "téléphone",
)
# Words that announce a number of a person's identity.
ID_CUES = (
    "ID card", "identity number", "identity card", "tax number", "tax ID", "passport no.", "passport number", "Ausweisnummer", "Ausweis",
    "Personalnr.", "Steuernummer", "Steuer-ID", "DNI", "NIF", "pasaporte", "Pièce d'identité", "pièce d'identité", "numéro fiscal",
    "passeport", "Passport", "passport", "Passport number", "Passport no.", "Reisepass", "Reisepassnummer", "Personalausweis", "NIE", "tax id", "Tax ID", "Tax number", "Social security number", "Social Security Number", "신분증 번호", "여권 번호", "주민등록번호", "SSN", "social security number", "social number", "national insurance number",
)
# Words for streets, by the side of the name on which they stand.
STREET_AFTER = ("Road", "Street", "Lane", "Avenue", "Close", "Rd", "St.", "Ave", "Drive", "Court", "Square", "Terrace", "Blvd", "Boulevard", "Crescent", "Parkway")
STREET_INSIDE = ("straße", "strasse", "weg ", "gasse ", "platz ", "stieg ", "Allee ", "Straße", "allee ", "damm ", "ring ")
STREET_BEFORE = ("rue ", "avenue ", "chemin ", "boulevard ", "place ", "allée ", "quai ", "C/ ", "Calle ", "Avda. ", "Plaza ")
FILE_ENDINGS = {"png", "jpg", "jpeg", "gif", "xlsx", "json", "csv", "txt", "pdf"}
# Titles and other words after which a name stands that need not be in the gazetteer.
NAME_CUES = (
    "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Professor", "Herr", "Herrn", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Sr", "Sra",
    "Don", "Doña", "Contact", "contact", "Kontakt", "Contacto", "signed by", "Signed by", "name is", "Name:", "firmó", "firmado por", "signé par", "실명은", "이름은",
)
# Words after which an initial with a capitalised word is a name; two capitalised words may be a nickname there.
INITIAL_CUES = ("by", "to", "from", "with", "and", "de", "à", "par", "et", "von", "mit", "und", "por", "para", "con")
#: Usual digits of a whole number by country code.
DIGITS_BY_COUNTRY = {"1": 11, "44": 12, "49": 12, "33": 11, "34": 11}
#: Fewest and most digits, country code and all, where a country's numbers differ in length.
DIGITS_RANGE = {"44": (9, 12), "49": (8, 13)}

#: Latin letters with or without accents, and digits: letters of other scripts stand next to an address without a blank.
_L = "A-Za-z0-9À-ÖØ-öø-ž"
_LOCAL = re.compile(rf"[{_L}](?:[{_L}_.+%\-]*[{_L}_])?\Z")
_DOMAIN = re.compile(rf" ?([{_L}-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[{_L}-]+)+)")
_NATIONAL = re.compile(
    r"\(\d{3}\) ?\d{3}[ -]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|00\d{2}(?:[  ]?\d{2,5}){2,4}|0\d{4}[  ]\d{6}|0\d{2}[  ]\d{4}[  ]\d{4}"
    r"|0\d{1,4}/\d{3,8}(?:-\d{1,5})?|0\d(?:[.  ]\d{2}){4}|0\d{9,10}"
)
_BRACKET = re.compile(r"\(\d{2,5}\)[ \xa0]?\d{2,8}(?:[ \xa0-]\d{2,6}){0,3}(?![\w/:]|[.,-]\d)", re.A)
_NUMBER_START = re.compile(r"[\s:.# ]{0,3}(?:(?:is|ist|es|est) )?(?=[+(\d])")
_ID = re.compile(
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{8}-\d{4}|\d{8}[A-Z]"
    r"|[A-Z]{2}\d{2}[A-Z]\d{5}|[XYZ]\d{7}[A-Z]|[A-Z]{1,2}\d{6,9}|\d{9,12}|[CFGHJK][CFGHJKLMNPRTVWXYZ0-9]{7}\d"
)
_ID_START = re.compile(r"[\s:.(# ]{0,3}")
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_TOWN = rf"(?:(?:North|South|East|West|Bad|Upper|New|Old|Saint|San|Le|La) )?{_CAP}(?: (?:de|del|di|am|an der|sur|upon) {_CAP})?"
_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}|\d{5})"
_EN_TAIL = re.compile(rf"(?:, (?:Flat|Apt\.?|Unit) \d+[A-Za-z]?)?(?:, {_TOWN}(?: {_CODE})?)?(?!\w)")
_EN_HEAD = re.compile(rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}\Z")
_DE_HEAD = re.compile(rf"(?<![\w-])(?:(?:Am|An der|Im|In der|Zum|Zur|Auf der) )?(?:{_CAP} ?)?\Z")
_DE_TAIL = re.compile(rf"\w* ?\d{{1,4}}[a-z]?(?!\w)(?:, \d{{5}} {_TOWN})?")
_FR_HEAD = re.compile(r"(?<![\w.,-])\d{1,5}(?: ?(?:bis|ter|[A-Za-z]))? \Z")
_FR_TAIL = re.compile(rf"(?:(?:de|du|des|la|le|les|l') ?){{0,2}}{_CAP}(?: {_CAP})*(?:, \d{{5}} {_TOWN})?")
_ES_TAIL = re.compile(rf"(?:(?:de|del|la|las|los|Los|Las|El|La) )?{_CAP}(?: {_CAP}){{0,3}},? \d{{1,4}}[a-z]?(?:, \d{{1,2}}\.?[ºª°] ?[A-Za-z]?)?(?:, \d{{5}} {_TOWN})?")


def _names(words: list[str]) -> str:
    return "|".join(sorted({v for w in words for v in (w, w.upper())}, key=len, reverse=True))


_WORD = r"(?:(?:O['’]|D['’]|Mc|Mac)?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]{2,})"
_F = rf"(?:{_names([*FAMILY_NAMES, *COMMON_FAMILY])})"
#: A family name of the first list with another one behind a hyphen, or a common one with any word there.
_FAMILY = rf"(?:(?:{_names(FAMILY_NAMES)})(?:-{_F})?|(?:{_names(list(COMMON_FAMILY))})(?:-{_WORD})?)"
_G = rf"(?:{_names([*GIVEN_NAMES, *COMMON_GIVEN])})"
_INITIALS = r"(?:[A-ZÀ-Þ]\. ?){1,2}"
_FAMILY_FIRST = re.compile(rf"{_FAMILY}, {_G}(?: [A-Z]\.)?(?![\w@])")
_GIVEN_FIRST = re.compile(rf"{_G}(?: [A-ZÀ-Þ]\.){{0,2}} {_FAMILY}(?![\w@])")
_INITIAL_FIRST = re.compile(rf"{_INITIALS}{_FAMILY}(?![\w@])")
# names outside the gazetteer: capitalised words, a third one only before a mark that ends it
_LAST = rf"(?:(?:de|del|la|du|di|da|van|von|der|den|ter) ){{0,2}}{_WORD}(?:-{_WORD})?"
_INITIAL_LAST = rf"(?:[A-ZÀ-Þ]\. ?){{1,2}}{_LAST}"
_FREE_NAME = re.compile(rf"(?:{_WORD}(?:-{_WORD})?(?: [A-ZÀ-Þ]\.){{0,2}} {_LAST}(?: {_WORD}(?=[.,;:!?)<\n]|\Z))?|{_INITIAL_LAST})(?![\w@])")
_FREE_INITIAL = re.compile(rf"{_INITIAL_LAST}(?![\w@])")
_NAME_START = re.compile(r"[.:]? {1,2}|: ?")
_INITIAL_HEAD = re.compile(r"(?<![\w.])(?:[A-ZÀ-Þ]\. ?){1,2}\Z")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    entries: dict[str, list[str]] = {}

    def put(words, kind: str) -> None:
        for w in words:
            entries.setdefault(w, []).append(kind)

    put(["@", "(at)", "[at]", "＠", "(AT)", "[AT]"], "at")
    put([" dot "], "dot")
    put(["+"], "plus")
    put(["("], "bracket")
    put(["00"], "zeros")
    put(NAME_CUES, "name")
    put(INITIAL_CUES, "initial")
    put(PHONE_CUES, "phone")
    put(ID_CUES, "id")
    put(STREET_AFTER, "street_after")
    put(STREET_INSIDE, "street_inside")
    put(STREET_BEFORE, "street_before")
    put([v for w in (*GIVEN_NAMES, *COMMON_GIVEN) for v in (w, w.upper())], "given")
    put([v for w in (*FAMILY_NAMES, *COMMON_FAMILY) for v in (w, w.upper())], "family")
    for w, kinds in entries.items():
        a.add_word(w, (len(w), tuple(kinds)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def _email(t: str, start: int, end: int) -> tuple[int, int] | None:
    """Expand an at-sign at ``[start, end)``."""
    left = start - 1 if start and t[start - 1] == " " else start
    local = _LOCAL.search(t, max(0, left - 64), left)
    domain = _DOMAIN.match(t, end)
    if not local or not domain:
        return None
    if (left != start) != (t[end : end + 1] == " "):
        return None
    labels = re.split(r"[.\s()\[\]]+", domain[1])
    if labels[-1].lower() in FILE_ENDINGS or not labels[-1].isalpha() or len(labels[-1]) < 2:
        return None
    return local.start(), domain.end()


def _spelled_email(t: str, dot: int) -> tuple[int, int] | None:
    """``name at host dot tld`` around the words ' dot '."""
    head = re.compile(r"([A-Za-z0-9][\w.+\-]*) at ([A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)*)\Z", re.A).search(t, max(0, dot - 96), dot)
    tail = re.compile(r"(?: dot [A-Za-z0-9-]+)+", re.A).match(t, dot)
    return (head.start(), tail.end()) if head and tail else None


def _international(t: str, start: int, lead: int = 1) -> tuple[int, int] | None:
    """A number from its plus sign or, with ``lead`` 2, its double zero.

    It ends at a group's end with the country's usual number of digits, else at
    the last one within what the country has; a bracketed trunk zero does not count.
    """
    if start and (t[start - 1].isalnum() or t[start - 1] in "._-"):
        return None
    i, digits, ends = start + lead, "", []
    while i < len(t):
        c = t[i]
        if t.startswith("(0)", i) and 0 < len(digits) <= 3:
            i += 3
            continue
        if c.isdigit() and c.isascii():
            digits += c
            if i + 1 == len(t) or not (t[i + 1].isdigit() or t[i + 1].isalpha()):
                ends.append((len(digits), i + 1))
        elif not (c in " \xa0.-/()" and digits and (t[i - 1].isdigit() or c in "( " and t[i - 1] in ") " or t[i - 1] == ")")):
            break
        elif c == " " and t[i - 1] == " ":
            break
        i += 1
        if len(digits) > 15:
            break
    country = next((cc for cc in DIGITS_BY_COUNTRY if digits.startswith(cc)), None)
    if country:
        exact = [e for n, e in ends if n == DIGITS_BY_COUNTRY[country]]
        if exact:
            return start, exact[0]
        if country not in DIGITS_RANGE:
            return None
    least, most = DIGITS_RANGE.get(country, (8, 15))
    fit = [e for n, e in ends if least <= n <= most]
    return (start, fit[-1]) if fit else None


def _zeros(t: str, start: int) -> tuple[int, int] | None:
    """A number that begins with a double zero, in groups unless its country is one of the known."""
    if start and t[start - 1] in ",:/+" or re.search(r"\d[ \xa0]\Z", t[max(0, start - 2) : start]) or t[start + 2 : start + 3] not in tuple("123456789"):
        return None
    span = _international(t, start, 2)
    if not span or not (t.startswith(tuple(DIGITS_BY_COUNTRY), start + 2) or re.search(r"[ \xa0./-]", t[start : span[1]])):
        return None
    return span


def _bracketed(t: str, start: int) -> tuple[int, int] | None:
    """A number whose area code stands in brackets, nine to twelve digits in all."""
    if not t[start + 1 : start + 2].isdigit() or start and (t[start - 1].isalnum() or t[start - 1] in ")]"):
        return None
    m = _BRACKET.match(t, start)
    return m.span() if m and 9 <= sum(c.isdigit() for c in m[0]) <= 12 else None


def _free_name(t: str, start: int, end: int, form: re.Pattern = _FREE_NAME) -> tuple[int, int] | None:
    """The capitalised name after a title or another word that announces it; names of the gazetteer are left to its parser."""
    if start and t[start - 1].isalnum():
        return None
    lead = _NAME_START.match(t, end)
    if not lead:
        return None
    at = lead.end()
    if _GIVEN_FIRST.match(t, at) or _INITIAL_FIRST.match(t, at) or _FAMILY_FIRST.match(t, at):
        return None
    m = form.match(t, at)
    if not m or set(re.split(r"[ .]+", m[0])) & set(NAME_CUES):
        return None
    return m.span()


def _phone_after(t: str, end: int) -> tuple[int, int] | None:
    lead = _NUMBER_START.match(t, end)
    if not lead:
        return None
    at = lead.end()
    if t[at] == "+":
        return _international(t, at)
    for m in (_NATIONAL.match(t, at),):
        if m:
            stop = m.end()
            if m[0].startswith("00"):
                want = next((n for cc, n in DIGITS_BY_COUNTRY.items() if m[0][2:].lstrip().startswith(cc)), None)
                stop = _cut_at_digits(t, at, stop, want + 2 if want else None)
            if not t[stop : stop + 1].isalnum():
                return at, stop
    return None


def _cut_at_digits(t: str, start: int, stop: int, want: int | None) -> int:
    if want is None:
        return stop
    n = 0
    for i in range(start, stop):
        n += t[i].isdigit()
        if n == want:
            return i + 1
    return stop


def _id_after(t: str, end: int) -> tuple[int, int] | None:
    at = _ID_START.match(t, end).end()
    m = _ID.match(t, at)
    if m and not t[m.end() : m.end() + 1].isalnum():
        return m.span()
    return None


def _address(t: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    back = max(0, start - 60)
    if kind == "street_after":
        head = _EN_HEAD.search(t, back, start)
        if not head or t[end : end + 1].isalnum():
            return None
        if t[end - 1] != "." and t[start:end] in ("Rd", "Ave") and t[end : end + 2] == ".,":
            end += 1
        return head.start(), _EN_TAIL.match(t, end).end()
    if kind == "street_inside":
        while start > back and t[start - 1].isalpha():
            start -= 1
        head = _DE_HEAD.search(t, back, start)
        if not t[start:start + 1].isupper():
            return None
        tail = _DE_TAIL.match(t, end)
        if not tail:
            return None
        first = start
        if head and head[0]:
            prefix = head[0]
            if re.match(r"(?:Am|An der|Im|In der|Zum|Zur|Auf der) $", prefix) or t[start:end].startswith(("Allee", "Straße")):
                first = head.start()
        return first, tail.end()
    if kind == "street_before":
        if t[start].isupper():
            if start and t[start - 1].isalnum():
                return None
            tail = _ES_TAIL.match(t, end)
            return (start, tail.end()) if tail else None
        head, tail = _FR_HEAD.search(t, back, start), _FR_TAIL.match(t, end)
        return (head.start(), tail.end()) if head and tail else None
    return None


def _person(t: str, start: int, kind: str) -> tuple[int, int] | None:
    if start and (t[start - 1].isalnum() or t[start - 1] in "_.@-" and not _INITIAL_HEAD.search(t, max(0, start - 6), start)):
        return None
    if kind == "given":
        m = _GIVEN_FIRST.match(t, start)
    else:
        head = _INITIAL_HEAD.search(t, max(0, start - 6), start)
        if head:
            m = _INITIAL_FIRST.match(t, head.start())
        else:
            m = _FAMILY_FIRST.match(t, start)
    return m.span() if m else None


def find_personal(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of every place, in order and without overlaps; of overlapping places the longer stays."""
    if not text:
        return []
    places: set[tuple[str, int, int]] = set()
    for last, (length, kinds) in _AUTOMATON.iter(text):
        start, end = last + 1 - length, last + 1
        for kind in kinds:
            span, name = None, kind
            if kind == "at":
                span, name = _email(text, start, end), "email"
            elif kind == "dot":
                span, name = _spelled_email(text, start), "email"
            elif kind == "plus":
                span, name = _international(text, start), "phone"
            elif kind == "bracket":
                span, name = _bracketed(text, start), "phone"
            elif kind == "zeros":
                span, name = _zeros(text, start), "phone"
            elif kind == "name":
                span, name = _free_name(text, start, end), "person"
            elif kind == "initial":
                span, name = _free_name(text, start, end, _FREE_INITIAL), "person"
            elif kind == "phone":
                span = _phone_after(text, end)
            elif kind == "id":
                span, name = _id_after(text, end), "id_number"
            elif kind in ("given", "family"):
                span, name = _person(text, start, kind), "person"
            else:
                span, name = _address(text, start, end, kind), "address"
            if span:
                places.add((name, *span))
    if len(places) < 2:
        return list(places)
    kept: list[tuple[str, int, int]] = []
    for p in sorted(places, key=lambda p: (p[1] - p[2], p[1], p[0])):
        if all(p[2] <= q[1] or p[1] >= q[2] for q in kept):
            kept.append(p)
    return sorted(kept, key=lambda p: p[1])


def redact(text: str | None, places: list[tuple[str, int, int]]) -> str | None:
    """The text with ``[KIND]`` in the place of each finding."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in places:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_places(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (doc_id, pii_kind, start_at, end_at), offsets in code points, end exclusive.

    Each text is read whole and by itself: no shuffle but that of the result.
    Null and empty texts have no places; copies of a document are each
    reported; rows that repeat an id count once; further columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *p) for d, t in zip(pdf["d"].tolist(), pdf["t"].tolist(), strict=True) for p in find_personal(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["d", "k", "s", "e"])

    slim = documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t is not null")
    found = slim.mapInPandas(run, "d bigint, k string, s bigint, e bigint")
    return found.select(F.col("d").alias(doc_id), F.col("k").alias("pii_kind"), F.col("s").alias("start_at"), F.col("e").alias("end_at")).distinct()


def redacted_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, places): every document with typed placeholders and the number of its places; null texts stay null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places = [find_personal(t) for t in pdf["t"]]
            yield pd.DataFrame({"d": pdf["d"], "t": [redact(t, p) for t, p in zip(pdf["t"], places, strict=True)], "n": [len(p) for p in places]})

    slim = documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    out = slim.mapInPandas(run, "d bigint, t string, n bigint")
    return out.select(F.col("d").alias(doc_id), F.col("t").alias(text), F.col("n").alias("places"))
