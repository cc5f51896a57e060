"""Personal information inside free text: e-mail addresses, phone and identity numbers, street addresses, names.

Regular expressions propose spans, each with a base score; validators (check letters and digits, Luhn, mod 97) raise
the score of numbers they confirm, and words near the span raise or lower it. Spans that reach THRESHOLD are kept; of
overlapping ones the kind that is named first in KINDS wins, then the longer. Positions are code points from 1, as in
the text itself: it isn't normalised first. Whole texts are searched.

Names are runs of capitalised words. What speaks for a run are titles and words of persons beside it, a given name,
and what all documents tell of its words (`learn`): words also written small or with an article are ordinary, words
that stand before several family names where a person is spoken of are given names, and words that stand behind many
words of no other use end the names of works and firms. A run of which no word is ordinary and that has nothing of a
work, firm or place is a name even where it occurs only once. Apart from that every row is treated by itself.

Defined cases: null and empty texts have no spans and come out unchanged; equal rows get equal results; a null id is
kept; other columns of the input are ignored by `spans`, kept by `redacted`. Without `learn` only what stands in the
text itself counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from lexloom.session import cut_lineage, discard

KINDS = ("email", "iban", "id_number", "card", "address", "phone", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
THRESHOLD = 0.6
NEAR = 45

# Some of the most common given names of the English, French, German and Spanish speaking countries.
GIVEN = """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul
Andrew George Kenneth Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret
Emily Michelle Laura Helen Emma Jean Pierre Michel André Philippe Alain Bernard Jacques Nicolas Julien François
Marie Nathalie Isabelle Sylvie Catherine Martine Françoise Sophie Camille Chloé Hans Peter Wolfgang Klaus Jürgen Werner
Stefan Andreas Karl Heinz Ursula Monika Petra Sabine Renate Karin Brigitte Anna Maria Lena Lukas Antonio José Manuel
Francisco Juan Javier Carlos Jesús Miguel Alejandro Carmen Ana Isabel Dolores Pilar Josefa Teresa Rosa Cristina Lucía""".split()
# Words that no name begins or ends with: articles, pronouns, prepositions, connectives, forms of letters.
FUNCTION = frozenset(
    """the a an this that these those my your his her its our their some any no every each of in on at by for from with to and
    or but if so as than then when while who whoever whose whom what which where why how it he she they we you i is was are
    not see der die das den dem des ein eine einen einem einer dieser diese dieses diesem unser unsere ihr ihre sein seine und
    oder aber wenn als wie wer was welche welcher welches wo warum mit nach von vom zu zum zur bei im in an am auf aus für über
    es er sie wir nicht kein keine le la les l un une des du de ce cet cette ces notre votre leur son sa ses et ou mais si
    que qui quel quelle quels quelles dans par pour avec sur chez il elle nous vous on el los las una unos unas este esta estos
    estas nuestro nuestra su sus y o pero cuando como quien cual en con sin por para del al no ya se page seite página""".split()
)
# Words of letters and forms beside a name.
FORM = frozenset(
    """yours sincerely regards cordially cordialement sincèrement atentamente saludos gruß grüße tel tél tfno fax email e-mail
    courriel correo address adresse anschrift dirección no nr id ssn dni nie nif nir isbn issn ms mss vol ed eds cf""".split()
)
# Words in names of works, institutions, firms and streets.
INSTITUTION = frozenset(
    """dictionary lexicon thesaurus glossary vocabulary wordbook handlist handbook index encyclopedia atlas grammar bible journal
    review gazette library archive press publishers books society institute university college school academy museum company
    limited ltd inc corp llc plc gmbh ag verlag wörterbuch lexikon handbuch zeitschrift gesellschaft verein institut universität
    schule bibliothek akademie dictionnaire lexique glossaire vocabulaire revue éditions société université école bibliothèque
    diccionario glosario léxico vocabulario revista editorial sociedad universidad escuela biblioteca instituto street road lane
    avenue ave row terrace square hill court close drive bridge park station church hospital hotel straße strasse platz weg""".split()
)
# Words before names of places.
PLACE = frozenset(
    """saint st san santa santo sankt sainte mount mt cape port fort lake river island isle bay north south east west new old
    upper lower great rue place boulevard quai calle plaza avenida paseo camino puerto río monte cabo kap berg see insel lac
    mont cap île rivière fleuve""".split()
)
NO_NAME = FUNCTION | FORM | INSTITUTION | PLACE
# Words near a span that speak for a kind.
CUES = {
    "phone": r"tel|tél|tfno|phone|fax|call|text me|number is|ring|mobile|handy|appele[zr]|llame|llamar|telefon|erreichbar|móvil|portable",
    "address": r"address|adresse|anschrift|dirección|domicil|lives|living|resid|moved to|sent to|posted to|wohn|habit|vive en|bitte an",
    "name_before": r"(?:\b(?:thanks to|according to|(?:checked|written|read|signed|edited|translated|collected|reviewed|proposed|made) by|dear|contact|comm\.|(?:who|he|she) (?:was|is)|yours,|regards,|sincerely,"
    r"|laut|nach|(?:geprüft|verfasst|geschrieben|übersetzt|gelesen|stammt|vorgeschlagen) von|dank an|liebe[r]?|gruß,|grüße,"
    r"|selon|d[’']après|(?:relu|écrit|signé|traduit|vérifié|proposé) par|(?:est|était) de|merci à|cher|chère|cordialement,|sincèrement,"
    r"|según|(?:revisado|escrito|firmado|traducido|propuesto) por|(?:es|era) de|gracias a|querid[oa]|atentamente,|saludos,))\s+$",
    "name_after": r"^[\s,]*(?:wrote|writes|said|says|told|asked|replied|answered|(?:dis)?agree[sd]?|argue[sd]|note[sd]|thinks|thought|believe[sd]|sent|has (?:seen|read|written|said|shown)|who (?:was|is|had|has)"
    r"|(?:the|an?) (?:\w+ )?(?:editor|author|translator|reader|teacher|professor|scholar|librarian|printer)"
    r"|schrieb|schreibt|sagt|sagte|meint|meinte|fragte|widerspricht|widersprach|glaubt|hat (?:gesagt|geschrieben|gesehen)|écrit|écrivait|dit|disait|pense|répond|n[’']est pas d[’']accord|a (?:écrit|dit|vu|lu)"
    r"|escribe|escribió|dice|dijo|piensa|opina|no está de acuerdo|ha (?:escrito|dicho|visto|leído))\b",
}
NOT_PHONE = r"(?:isbn|issn|order of|entry ids?|call number|shelfmark|ms|checked|verse|version|lemma no\.|\bno\.|page|pages|seite|passport|passeport n°|pasaporte|steuer\S*|ssn|nir|dni|nie|nummer|number)[\s:.]*(?:ms\s*)?$"
TITLES = r"(?:Dr|Prof|Mr|Mrs|Ms|M|Mme|Mlle|Herr|Frau|Sra|Sr|D\.ª|D|Don|Doña)\.?"

DOT = r"(?:\.| ?[\[({] ?(?:dot|punkt|point|punto) ?[\])}] ?)"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w][\w.+%-]*(?:@| ?[\[({{] ?(?:at|arroba|arobase) ?[\])}}] ?)[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,24}}\b", re.I)

ID_LABEL = (
    r"(?:SSN|social security (?:number|no\.?)|national insurance (?:number|no\.?)|NINO|passport (?:number|no\.?)|identity card (?:number|no\.?)|tax (?:id|number)|"
    r"NIR|n[°º] de sécurité sociale|numéro de sécurité sociale|passeport(?: n[°º])?|carte d[’']identité(?: n[°º])?|numéro fiscal|"
    r"DNI|NIE|NIF|pasaporte(?: n\.?[°º])?|n\.?º de la seguridad social|"
    r"Steuer-?ID(?:-Nr\.?)?|Steuernummer|Steueridentifikationsnummer|Personalausweis(?:\s?-?\s?Nr\.?)?|Reisepass(?:\s?-?\s?Nr\.?)?|Ausweis(?:nummer|-?Nr\.?)?|Sozialversicherungsnummer)"
)
#: Every label holds one of these, casefolded.
ID_SIGNS = ("ssn", "security", "insurance", "nino", "passport", "passeport", "pasaporte", "reisepass", "identi", "ausweis", "tax ", "steuer", "fiscal", "nir", "dni", "nie", "nif", "curité", "seguridad", "versicherung")
ID = re.compile(rf"(?<!\w){ID_LABEL}\s*(?:[:#]|no\.?|nr\.?|n[°º]|n\.º)?\s*:?\s*(?P<n>[A-Z]{{0,3}}[ .-]?\d[\dA-Z]*(?:[ ./-][\dA-Z]*\d[\dA-Z]*)*(?:[ -]?[A-Z])?)(?!\w)", re.I)
#: Numbers that give themselves away by their form; only a validator can carry these over the threshold.
BARE_ID = re.compile(r"(?<![\w.-])(?:[12][ .]?\d\d[ .]?\d\d[ .]?\d[\dAB][ .]?\d{3}[ .]?\d{3}[ .]?\d\d|[XYZ]?\d{1,2}\.?\d{3}\.?\d{3}-?[A-Z]|[XYZ]\d{7}-?[A-Z])(?!\w)")

CARD = re.compile(r"(?<![\w.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")

W = r"[A-ZÀ-ÖØ-ÞŁŠŽČ][\w’'-]*"
TOWN = rf"(?:(?:,|\s*\n)\s*(?:\d{{4,5}} )?{W}(?: \d{{4,5}})?|\s+\d{{5}} {W})?"
ADDRESS = re.compile(
    rf"(?<![\w])(?:"
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+\w?, ?)?\d{{1,4}}[A-Za-z]? (?:{W} ){{1,3}}(?:Road|Rd\.?|Row|Street|St\.?|Terrace|Avenue|Ave\.?|Lane|Close|Drive|Square|Hill|Court|Place|Way)(?![\w]){TOWN}"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|place|boulevard|bd|quai|impasse|chemin|allée|cours|route)(?: (?:des?|du|de la|de l’|la|le|les|l’|d’))* ?{W}{TOWN}"
    rf"|(?:Calle|C/|C\.|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía)(?: (?:de la|de los|de las|del|de))? ?{W},? (?:n\.?[º°] ?)?\d{{1,4}}\w?(?:, ?\d+\.?[º°ª] ?\w?)?{TOWN}"
    rf"|{W}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|-Str\.|-Straße|-Weg|-Platz|-Allee) \d{{1,4}} ?[a-z]?(?!\w){TOWN}"
    rf"|(?:Am|An der|Zum|Zur|Im|In der|Auf dem|Auf der) {W} \d{{1,4}} ?[a-z]?(?!\w){TOWN}"
    rf")"
)
PHONE = re.compile(r"(?<![\w.,/+-])(?:\+|\()?\d(?:[ ./()-]{0,2}\d){6,15}(?!\w|[.,/-]\d)")

_particle = r"(?:(?:von|van|de la|de|del|der|den|zu|di|da|du) |d[’'])"
#: A capitalised word; of letters outside Latin-1 the case is looked at afterwards.
NAME_WORD = r"[^\W\d_a-zß-öø-ÿ][\w’'-]*"
#: Words that stand beside each other with single spaces; initials and particles belong to the word behind them.
NAME_RUN = re.compile(rf"(?<![\w’'@.-]){NAME_WORD}(?: (?:[A-ZÀ-Þ]\.(?= )|{_particle}{{0,2}}{NAME_WORD}))+(?![\w@])")
NAME_LAST = re.compile(rf"(?<![\w’'@.-])(?P<f>{W}), (?P<g>{W})(?![\w’'])")
_PART = re.compile(rf"[A-ZÀ-Þ]\.|({_particle}{{0,2}})({NAME_WORD})")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return bool(digits) and total % 10 == 0


def valid_nir(n: str) -> bool:
    """French social security numbers: the last two digits are 97 less the rest mod 97."""
    n = n.replace("2A", "19").replace("2B", "18")
    return len(n) == 15 and n.isdigit() and 97 - int(n[:13]) % 97 == int(n[13:])


def valid_dni(n: str) -> bool:
    """Spanish DNI and NIE: the letter is given by the number mod 23."""
    if len(n) != 9 or not n[-1].isalpha():
        return False
    body = {"X": "0", "Y": "1", "Z": "2"}.get(n[0], n[0]) + n[1:8]
    return body.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23] == n[-1]


def valid_tax_id(n: str) -> bool:
    """German tax numbers of 11 digits, ISO 7064 mod 11, 10."""
    if len(n) != 11 or not n.isdigit():
        return False
    p = 10
    for d in n[:10]:
        s = (int(d) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(n[10])


def valid_iban(n: str) -> bool:
    """ISO 13616: with the first four signs moved behind the others and letters as 10 to 35, the rest mod 97 is 1."""
    n = re.sub(r"\s", "", n).upper()
    return 15 <= len(n) <= 34 and n.isalnum() and n.isascii() and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def confirmed(n: str) -> bool:
    n = re.sub(r"[ ./-]", "", n).upper()
    return valid_nir(n) or valid_dni(n) or valid_tax_id(n) or (len(n) == 16 and n.isdigit() and luhn(n))


def _cued(pattern: re.Pattern, text: str, start: int, end: int) -> tuple[bool, bool]:
    return bool(pattern.search(text[max(0, start - NEAR) : start])), bool(pattern.search(text[end : end + NEAR]))


_cues = {k: re.compile(v, re.I) for k, v in CUES.items()}
_not_phone = re.compile(NOT_PHONE, re.I)
_given = {g.casefold() for g in GIVEN}


def _emails(text: str) -> Iterator[Span]:
    if "@" in text or re.search(r"[\[({] ?(?:at|arroba|arobase) ?[\])}]", text, re.I):
        for m in EMAIL.finditer(text):
            yield Span("email", m.start(), m.end(), 0.9)


def _ids(text: str, bare: bool = True) -> Iterator[Span]:
    low = text.casefold()
    for m in ID.finditer(text) if any(x in low for x in ID_SIGNS) else ():
        n = m["n"]
        digits = sum(c.isdigit() for c in n)
        if digits >= 5:
            yield Span("id_number", m.start("n"), m.end("n"), 0.5 + 0.2 * (digits >= 6) + 0.3 * confirmed(n))
    for m in BARE_ID.finditer(text) if bare else ():
        yield Span("id_number", m.start(), m.end(), 0.3 + 0.4 * confirmed(m[0]))


def _ibans(text: str) -> Iterator[Span]:
    for m in IBAN.finditer(text):
        yield Span("iban", m.start(), m.end(), 0.3 + 0.6 * valid_iban(m[0]))


def _cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        n = re.sub(r"\D", "", m[0])
        yield Span("card", m.start(), m.end(), 0.2 + 0.4 * (luhn(n) and n[0] in "23456") + 0.2 * bool(re.search(r"card|karte|carte|tarjeta|visa", text[max(0, m.start() - NEAR) : m.start()], re.I)))


def _addresses(text: str) -> Iterator[Span]:
    for m in ADDRESS.finditer(text):
        before, after = _cued(_cues["address"], text, m.start(), m.end())
        yield Span("address", m.start(), m.end(), 0.6 + 0.2 * (before or after))


def _phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        s = m[0]
        digits = re.sub(r"\D", "", s)
        if not 8 <= len(digits) <= 15:
            continue
        before, after = _cued(_cues["phone"], text, m.start(), m.end())
        score = 0.2 + 0.4 * (before or after)
        score += 0.4 * (s[0] in "+(" or digits[0] == "0")
        score += 0.4 * bool(re.fullmatch(r"(?:1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|[6789]\d\d(?: \d{2,3}){2,3}", s))
        score -= 0.5 * bool(_not_phone.search(text[max(0, m.start() - NEAR) : m.start()]))
        if s[0] == "(" and s.count("(") != s.count(")"):
            continue
        yield Span("phone", m.start(), m.end(), score)


class Learned(NamedTuple):
    """What all documents tell of words, casefolded. ordinary: also written small, or behind an article."""

    given: frozenset[str] = frozenset()
    heads: frozenset[str] = frozenset()
    ordinary: frozenset[str] | None = None


NOTHING = Learned()


class Part(NamedTuple):
    start: int
    end: int
    word: str  # casefolded, without particle
    shown: str


def _told(text: str, start: int, end: int) -> tuple[bool, bool, bool]:
    """Whether words before, words after and a title tell that a name stands here."""
    before = text[max(0, start - NEAR) : start]
    title = _titled.search(before[-8:])
    plain = before[: len(before) - len(title[0])] if title else before
    # the pattern is tried only where the last word ends one of its cues
    last = plain.split()[-1:] or [""]
    return last[0].casefold() in CUE_ENDS and bool(_cues["name_before"].search(plain)), bool(_cues["name_after"].match(text[end : end + NEAR])), bool(title)


_titled = re.compile(rf"(?<!\w){TITLES}\s\Z")
#: The last words of the cues before names.
CUE_ENDS = frozenset(
    "to by dear contact comm. (comm. was is yours, regards, sincerely, laut nach von an liebe lieber gruss, grüsse, selon après d'après d’après par de à cher chère cordialement, sincèrement, según por a querido querida atentamente, saludos,".split()
)


_elided = re.compile(r"\w{1,2}[’'][^\W\d_A-ZÀ-ÖØ-Þ]")
_title = re.compile(rf"{TITLES}\Z")


def _runs(text: str, learned: Learned = NOTHING) -> Iterator[tuple[list[Part], bool, bool]]:
    """Runs of two or more words that could be a name, whether the word before one is an article, and whether it belongs to a work, firm or place."""
    ordinary = learned.ordinary or ()
    known = lambda w: w in _given or w in learned.given
    for m in NAME_RUN.finditer(text):
        own: list[Part] = []
        article = small = False
        parts = [Part(m.start() + p.start(), m.start() + p.end(), (p[2] or p[0]).casefold(), p[2] or p[0]) for p in _PART.finditer(m[0])]
        for p in [*parts, None]:
            w = "." if p is None else p.word
            # an ordinary word beside a given name can be a family name
            stops = p is None or w in FUNCTION or w in FORM or not p.shown[0].isupper() or _elided.match(p.shown) or (_title.match(p.shown) and not own and len(w) < 5) or (w in ordinary and not known(w) and not (own and known(own[-1].word)))
            if not stops:
                own.append(p)
                continue
            if p is not None and _title.match(p.shown) and not own:
                continue
            while own and len(own[-1].shown) == 2 and own[-1].shown[1] == ".":
                own.pop()
            names = [q for q in own if q.shown[-1] != "."]
            if len(names) > 1:
                before = text[max(0, own[0].start - 12) : own[0].start].split()
                small = bool(before) and before[-1].casefold() in ARTICLES and text[own[0].start - 1] in " \n"
                work = any(q.word in INSTITUTION or q.word in learned.heads for q in own[1:]) or own[0].word in PLACE or own[0].word in INSTITUTION or (p is not None and (w in INSTITUTION or w in learned.heads))
                yield own, small or article, work
            own, article = [], p is not None and w in ARTICLES
    return


ARTICLES = frozenset("the a an this that these der die das den dem des ein eine einem einen einer le la les un une ce cette el los las una".split())
_one_word = re.compile(r"\W*([^\W\d_]+)\W*")
_det = re.compile(rf"(?<!\w)(?<!de )(?:{'|'.join(sorted(ARTICLES))}) ({NAME_WORD})")


def name_evidence(text: str) -> Iterator[tuple[str, str, bool]]:
    """given, family, told: of each two words that could be a name, and whether the words beside them tell so."""
    for own, article, work in _runs(text):
        told = not article and not work and any(_told(text, own[0].start, own[-1].end))
        names = [q for q in own if q.shown[-1] != "."]
        for a, b in zip(names, names[1:]):
            if len(a.word) > 1 and len(b.word) > 2:
                yield a.word, b.word, told


def learn(documents: DataFrame, text: str = "text", least: int = 3, share: float = 0.3) -> Learned:
    """Given names, last words of works and firms, and ordinary words, from all documents.

    A given name is told by the words beside it before `least` different family names, and before a `share` of all. A
    last word stands behind many different words that stand before hardly any other. A word is ordinary if a tenth of
    its documents have it in small letters, or, of words that are no given names, a third have an article before it. One pass gathers distinct words by batch, so what
    is shuffled is a vocabulary, not the texts. Fetched are given names and last words, of which there are few, and
    those ordinary words that occur capitalised beside another: a part of the vocabulary of a language, which grows
    slowly; names, of which there are many, aren't among them.
    """
    from pyspark.sql import functions as F

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs, tokens, small, large, article = set(), Counter(), Counter(), Counter(), Counter()
            for t in b["text"]:
                if not t:
                    continue
                pairs.update(name_evidence(t))
                tokens.update(set(t.split()))
                article.update({w.casefold() for w in _det.findall(t)})
            for token, n in tokens.items():
                # parts of addresses such as a.b@c are no words
                if m := _one_word.fullmatch(token):
                    (small if m[1].islower() else large)[m[1].casefold()] += n
            rows = [("pair", a, f, told, 0, 0, 0) for a, f, told in sorted(pairs)]
            rows += [("word", w, "", False, small[w], large[w], article[w]) for w in sorted(small.keys() | large.keys())]
            yield pd.DataFrame(rows, columns=["what", "given", "family", "told", "small", "large", "article"])

    seen = cut_lineage(documents.select(F.col(text).alias("text")).mapInPandas(gather, "what string, given string, family string, told boolean, small long, large long, article long"), "names")
    pairs = cut_lineage(seen.filter("what = 'pair'").groupBy("given", "family").agg(F.max("told").alias("told")), "pairs")
    rights = pairs.groupBy("given").agg(F.count_if("told").alias("told"), F.count("*").alias("n"))
    given = rights.filter((F.col("told") >= least) & (F.col("told") >= share * F.col("n"))).select("given")
    usual = rights.filter(F.col("n") >= least).select("given", F.lit(1).alias("usual"))
    lefts = pairs.join(usual, "given", "left").groupBy("family").agg(F.count("*").alias("n"), F.count("usual").alias("usual"), F.count_if("told").alias("told"))
    heads = lefts.filter((F.col("n") >= 2 * least) & (F.col("usual") < 0.3 * F.col("n")) & (F.col("told") < share * F.col("n"))).select("family")
    paired = pairs.select(F.explode(F.array("given", "family")).alias("given")).distinct()
    words = seen.filter("what = 'word'").join(paired, "given", "left_semi").groupBy("given").agg(*[F.sum(c).alias(c) for c in ("small", "large", "article")])
    low = words.filter(F.col("small") * 10 >= F.col("small") + F.col("large")).select("given")
    with_article = words.filter(F.col("article") * 3 >= F.col("small") + F.col("large")).select("given").join(given, "given", "left_anti")
    out = Learned(*(frozenset(r[0] for r in df.collect()) for df in (given.join(low, "given", "left_anti"), heads, low.unionByName(with_article))))
    discard(seen, pairs)
    return out


def learned_given(documents: DataFrame, text: str = "text", least: int = 3, share: float = 0.3) -> frozenset[str]:
    return learn(documents, text, least, share).given


def _names(text: str, learned: Learned = NOTHING) -> Iterator[Span]:
    is_given = lambda w: w in _given or w in learned.given
    for own, article, work in _runs(text, learned):
        names = [q for q in own if q.shown[-1] != "."]
        if work or len(names[-1].word) < 3:
            continue
        # of a longer run, the name begins with its first given name
        if len(names) > 3 and (at := next((i for i, q in enumerate(names[:-1]) if is_given(q.word)), None)) is not None:
            own = own[own.index(names[at]) :]
            names = names[at : at + 3]
            own = own[: own.index(names[-1]) + 1]
        start, end = own[0].start, own[-1].end
        known = is_given(names[0].word) or (len(names) > 2 and is_given(names[1].word))
        before, after, titled = _told(text, start, end)
        shape = learned.ordinary is not None and not article and len(names) < 4 and not all(q.shown.isupper() for q in names) and not names[0].shown[1:].isupper()
        shape = shape and not any(q.word in learned.ordinary or len(q.word) < 3 for q in names)
        score = 0.2 + 0.5 * known * (not article) + 0.4 * (before or titled) + 0.4 * after + 0.4 * shape
        if is_given(names[-1].word) and not known:
            score -= 0.3
        yield Span("name", start, end, min(score, 1.0))
    at = 0
    while m := NAME_LAST.search(text, at):
        at = m.start() + len(m["f"])
        given, last = m["g"].casefold(), m["f"].casefold()
        known = is_given(given)
        if not NO_NAME.isdisjoint((given, last)) or len(last) < 3 or is_given(last) or given in (learned.ordinary or ()) and not known:
            continue
        if (n := re.match(rf"(?: [A-ZÀ-Þ]\.)? (?:von |van |de la |de |del |der |d[’'])?({W})", text[m.end() : m.end() + 60])) and n[1].casefold() not in NO_NAME:
            continue  # the given name belongs to the family name behind it
        before, after, _ = _told(text, m.start(), m.end())
        yield Span("name", m.start(), m.end(), min(0.2 + 0.4 * known + 0.4 * before + 0.4 * after, 1.0))


#: Seven digits with little between them, without which there is no number of a phone, card, account or person that isn't labelled.
_number = re.compile(r"\d(?:[ ./()-]{0,3}\d){6}")


def _labelled_ids(text: str) -> Iterator[Span]:
    return (s for s in _ids(text, bare=False))


def find(text: str | None, learned: Learned = NOTHING) -> list[Span]:
    """The spans of a text in order, without overlaps; learned: what other documents tell, see learn."""
    if not text:
        return []
    kept: list[Span] = []
    numbers = _number.search(text) is not None
    of_numbers = (_ibans, _ids, _cards, _addresses, _phones) if numbers else (_labelled_ids, _addresses)
    for propose in (_emails, *of_numbers, lambda t: _names(t, learned)):
        for s in sorted(propose(text), key=lambda s: (s.start - s.end, s.start)):
            if s.score >= THRESHOLD - 1e-9 and all(s.end <= k.start or s.start >= k.end for k in kept):
                kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redact(text: str | None, learned: Learned = NOTHING) -> str | None:
    """The text with each span replaced by the placeholder of its kind and nothing else changed."""
    if not text:
        return text
    parts, at = [], 0
    for s in find(text, learned):
        parts += [text[at : s.start], PLACEHOLDER[s.kind]]
        at = s.end
    return "".join(parts) + text[at:]


#: What no span can be without; texts without any stay in the JVM.
ANY = r"[@\d]|[(\[{] ?(?i:at|arroba|arobase)|(?U)\p{Lu}[\w’'-]* (?:[\p{Ll}’' ]{1,7})?\p{Lu}|\p{Lu}[\w’'-]*, \p{Lu}"


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, kind, start_pos, end_pos (of the last character), score: one row per occurrence."""
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = shared.value
        for b in batches:
            rows = [(d, s.kind, s.start + 1, s.end, s.score) for d, t in zip(b.doc_id, b.text) for s in find(t, learned)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos", "score"]).astype({"doc_id": "Int64", "start_pos": "int64", "end_pos": "int64", "score": "float64"})

    from pyspark.sql import functions as F

    return documents.select("doc_id", "text").filter(F.col("text").rlike(ANY)).mapInPandas(search, "doc_id bigint, kind string, start_pos bigint, end_pos bigint, score double")


def redacted(documents: DataFrame, text: str = "text", to: str = "redacted_text") -> DataFrame:
    """documents with a column of redacted texts; a column of that name is replaced."""
    from pyspark.sql import functions as F

    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, text))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: redact(t, shared.value))

    own = F.col(text)
    return documents.withColumn("_redacted", clean(F.when(own.rlike(ANY), own))).withColumn(to, F.coalesce("_redacted", own)).drop("_redacted")
