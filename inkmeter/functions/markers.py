"""The marker catalogue: predicates and counts as native columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import java
from .sentences import sentence_length_cv

# ---- fixed values: the patterns of the markers, in ECMAScript ----
WORDS = {
    "delve": r"\bdelv(e|es|ing|ed)\b",
    "tapestry": r"\btapestr(y|ies)\b",
    "moreover": r"\bmoreover\b",
    "furthermore": r"\bfurthermore\b",
    "crucial": r"\bcrucial(ly)?\b",
    "realm": r"\brealms?\b",
    "showcase": r"\bshowcas(e|es|ing|ed)\b",
    "underscore": r"\bunderscor(e|es|ing|ed)\b",
}
LEVERAGE = r"\b(?:(?<!\b(?:have|has|had|gain|gains|gained|its|their|his|her|our|your|my|high|low|statistical|financial|political|operating|much|real|no|of|the|a|some|any|more|less|enough|\d{1,9}x)\s)leverage|leverag(?:es|ing|ed))\b(?!\s+(?:trades?|buyouts?|loans?|positions?|etfs?|ratios?)\b)"
PHRASES = {
    "important_to_note": r"\bit(?:['’]?s| is|(?: may| might| would| could) be)(?: (?:also|still|always|very|especially|particularly|equally|generally|however|therefore|thus|perhaps|probably|definitely|certainly),?)* (?:important|worth) (?:to )?not(?:e|ing)\b",
    "in_todays": r"\bin today['’]?s\b",
    "not_only_but_also": r"\bnot only\b(?:[^.!?]|\b(?:e\.g|i\.e|et al|vs|cf)\.|\.(?=\d)){0,160}?\bbut(?: \w+){0,3}? also\b",
    "not_x_its_y": r"\b(?:it|this|that)(?:['’]?s not| is not| isn['’]?t) (?:just |only |merely |simply )?[^.!?,;:]{2,40}?(?:[,;:]|\s?[—–]|\s-{1,3}|-{1,3}\s|---)\s*(?:it|this|that)(?:['’]?s| is)\b(?!(?<=\bthat is),)",
    "dive_into": r"\b(dive into|let(['’]?s| us) (explore|take a look|dive))\b",
    "in_conclusion": r"\b(?:(?:in conclusion|in summary)\b|(?:in sum|to sum (?:it |this |things |everything )?up|to summari[sz]e|to conclude)\b(?=\s*[,:]))",
}
DASH = r"—|(?<![-|+:])(?!(?<=^[^\S\n]{0,99})---[^\S\n]*$)---(?![-|+:])|(?<=[^\S\n])--(?=\s)|(?<=(?:[A-Za-z'’][A-Za-z]|[.\w][)\"'”’])[^\S\n])[-–](?=\s[A-Za-z\"“(])"
_FIRST = r"(?<!\b(?:January|February|March|April|May|June|July|August|September|October|November|December) )\b(?!(?:However|Moreover|Furthermore|Recently|Thus|Therefore|Hence|Additionally|Also|Finally|Still|Here|Now|Then|Overall|Yes|So|Well|Hopefully|Interestingly|Indeed|Instead|Similarly|Specifically|Currently|example|instance|particular|addition|course)\b)(?!(?:1[5-9]|20)\d\d\b)\w+"
_MIDDLE = r"(?![^,.;\n]*\b(?:we|I|it|they|you|he|she|there|is|are|was|were|has|have|had|will|would|can|could|may|might|should|but|namely|via|say)\b)\w+(?: \w+){1,3}"
_AND = r"(?:and|(?<!\b(?:with|whether|one|sooner|more|less) )or(?! (?:not|more|less|so|after|before)\b))"
RULE_OF_THREE = rf"{_FIRST}, \w+,? {_AND} \w+\b|{_FIRST}, {_MIDDLE}, {_AND} \w+\b"
CONTRACTION = r"\b(?!van['’]t\b)\w+['’](?:t|re|ve|ll|m)\b|\b(?:i|you|he|she|we|they|it|that)['’]d\b|\b(?:it|that|there|here|what|who|where|how|he|she|let)['’]s\b"
BARE_CONTRACTION = r"(?<![\p{L}\p{N}_\\\"'’])(?:(?:do|does|did|is|are|was|were|has|have|had|could|would|should|must|need)nt|cant|youre|theyre|thats|whats|theres|(?:you|they|we)ve|(?:would|could|should|must)ve)(?![\p{L}\p{N}_'’])"
AFTER_I = "not|so|a|an|the|no|just|going|gonna|trying|still|also|really|very|sure|glad|sorry|here|in|at|on|pretty|kind|looking|getting|thinking|feeling|now|always|never|currently|about|afraid|happy|tired|done|from|with|using|working|having|doing|starting|planning|curious|wondering|asking|only|actually|literally|honestly|probably|definitely|finally|okay|ok|fine|good|been|had|got|gotten|seen|tried|heard|noticed|found|read|made|started|lost|gone|spent|known|played|used|ever|already|recently|come|bought|watched|learned|decided|thought|felt|wanted|asked|looked|lived"
BARE_I = rf"(?<![\p{{L}}\p{{N}}_\\\"'’])(?:(?:im|ive)(?= [a-z])|(?:Im|Ive)(?= (?:{AFTER_I})(?![\p{{L}}\p{{N}}_])))"
FIRST_PERSON = r"(?<![$\\{\/&\w]|[^-]-|^-)(?<!\b(?:Type|Types|Phase|Part|Stage|Class|Grade|Level|Section|Chapter|Table|Figure|Fig\.|Appendix|Case|Model|Step|Method|Lemma|Theorem|World War|Schedule|Paper|Category|category)\s)\bI(?:['’](?:m|ve|d|ll)|(?=\s+(?!(?:is|has|in|errors?|(?:and|or)\s+II)\b)[a-z])|(?<=\b(?:am|was|were|did|do|have|had|than|and|can|could|would|should|will)\sI)(?=\s*[.!?,;:]))|(?<!\p{L})(?:[Mm]y|[Mm]e|[Mm]yself|MY)(?!\p{L})|(?<![(\[.$\\\/\w-])\bi(?:['’](?:m|ve|d|ll)\b|\s+(?:(?:think|am|was|have|had|do|did|can|cannot|could|would|will|know|guess|mean|feel|agree|believe)(?:n['’]?t)?|won['’]?t)\b)"
QUOTED = r"(?<!\\)\"[^\"]{0,300}(?<!\\)\"|“[^”]{0,300}”"
PERSONAL = r"\b(my (wife|husband|kid|son|daughter|dad|mum|mom|friend|boss|team)|last (year|week|night|summer)|when i was)\b"
INFORMAL = r"\b(gonna|wanna|kinda|sorta|dunno|yeah|nope|lol|imo|iirc|afaik|tbh)\b"
BULLETED_BOLD = r"^\s*[-*•]\s+\*\*"
TITLE_HEADING = r"^#{1,6}[ \t]+(?:[A-Z][a-z]+(?:[ \t]+|$)){2,}"
UNIFORM_BELOW = 0.40
# ---- end of the fixed values ----

#: What every match of a countable marker holds, in lower case: one of the listed strings. A text
#: without any of them has no match, which a search for a plain string tells sooner than the pattern.
HOLDS = {
    "delve": ["delv"], "tapestry": ["tapestr"], "moreover": ["moreover"], "furthermore": ["furthermore"], "crucial": ["crucial"], "realm": ["realm"], "showcase": ["showcas"], "underscore": ["underscor"],
    "leverage": ["leverag"], "important_to_note": ["important ", "worth "], "in_todays": ["in today"], "not_only_but_also": ["not only"], "not_x_its_y": ["s not ", "isn"],
    "dive_into": ["dive", "explore", "take a look"], "in_conclusion": ["in conclusion", "in sum", "to sum", "to conclude"], "em_dash": ["—", "–", "-"], "rule_of_three": [" and ", " or "],
}
#: What stands where a match of a costly pattern begins, without its vetoes: looked for first, it spares the vetoes elsewhere.
BEGINS = {
    "rule_of_three": r"(?<!\w)(?=\w+, \w+(?:(?: \w+){1,3},|,?) (?:and|or) \w)", "em_dash": "(?=[—–-])", "leverage": "(?=leverag)",
    "no_first_person": "(?=[IMmi])", "no_personal_detail": "(?=[mlw])", "no_typo_markers": "(?=[gwksdynlita])", "contraction": r"(?<!\w)(?=\w+['’])", "bare_contraction": "(?=[diawhcsmnyt])", "bare_i": "(?=[iI])",
}
#: The same as patterns, for markers whose plain strings most texts hold.
NEAR = {"em_dash": r"—|--|[^\S\n][-–]\s", "rule_of_three": r", [\w ]+,? (?:and|or) \w"}


@dataclass(frozen=True)
class Marker:
    """A marker. ``count`` is None for markers of a whole text; ``eligible`` tells
    which texts it can judge; ``open_ended`` matches carry the writer's own words."""

    id: str
    family: str
    test: Callable[[Column], Column]
    count: Callable[[Column], Column] | None = None
    pattern: str | None = None
    eligible: Callable[[Column], Column] | None = None
    belief: bool = False
    open_ended: bool = False

    def may(self, readable_: Column | str, lower: Column | str) -> Column:
        """Whether a text can hold a match at all, from the readable text and its lower case."""
        found = reduce(Column.__or__, (F.contains(lower, F.lit(x)) for x in HOLDS[self.id]))
        return found & F.rlike(readable_, F.lit(java(NEAR[self.id]))) if self.id in NEAR else found

    def counted(self, readable_: Column, lower: Column) -> Column:
        """The count; the pattern runs only where it can match."""
        return F.when(self.may(readable_, lower), F.regexp_count(readable_, F.lit(self.pattern)).cast("long")).otherwise(F.when(readable_.isNotNull(), F.lit(0).cast("long")))


def begun(name: str, pattern: str, flags: str = "") -> str:
    """``pattern`` for Java, tried only where a match of it can begin."""
    return java(f"{BEGINS[name]}(?:{pattern})" if name in BEGINS else pattern, flags)


def readable(text: Column) -> Column:
    """The text as a reader sees it, without the marks for bold."""
    return F.replace(text, F.lit("**"), F.lit(""))


def own_words(text: Column) -> Column:
    """The text with quoted spans blanked out."""
    return F.when(F.contains(text, F.lit('"')) | F.contains(text, F.lit("“")), F.regexp_replace(text, java(QUOTED), " ")).otherwise(text)


def _countable(id_: str, family: str, pattern: str, flags: str = "i", **more) -> Marker:
    made = begun(id_, pattern, flags)
    return Marker(id_, family, lambda t: readable(t).rlike(made), lambda t: BY_ID[id_].counted(readable(t), F.lower(readable(t))), made, **more)


def has_contraction(text: Column) -> Column:
    apostrophe = F.contains(text, F.lit("'")) | F.contains(text, F.lit("’"))
    return (apostrophe & text.rlike(begun("contraction", CONTRACTION, "i"))) | text.rlike(begun("bare_contraction", BARE_CONTRACTION, "iu")) | text.rlike(begun("bare_i", BARE_I, "u"))


def _catalogue() -> list[Marker]:
    made = [_countable(k, "word", p) for k, p in WORDS.items()]
    made.append(_countable("leverage", "word", LEVERAGE))
    made += [_countable(k, "phrase", p, open_ended=k in ("not_only_but_also", "not_x_its_y")) for k, p in PHRASES.items()]
    made.append(Marker("uniform_sentences", "shape", lambda t: F.coalesce(sentence_length_cv(readable(t)) < UNIFORM_BELOW, F.lit(False)), eligible=lambda t: sentence_length_cv(readable(t)).isNotNull()))
    made.append(_countable("em_dash", "shape", DASH, "m"))
    made.append(Marker("em_dash_heavy", "shape", lambda t: BY_ID["em_dash"].count(t) >= 2))
    made.append(_countable("rule_of_three", "shape", RULE_OF_THREE, "", open_ended=True))
    made.append(Marker("bulleted_bold", "shape", lambda t: F.contains(t, F.lit("**")) & t.rlike(java(BULLETED_BOLD, "m"))))
    made.append(Marker("no_contraction", "surface", lambda t: ~has_contraction(own_words(readable(t))), belief=True))
    made.append(Marker("no_first_person", "surface", lambda t: ~own_words(readable(t)).rlike(begun("no_first_person", FIRST_PERSON, "u")), belief=True))
    made.append(Marker("no_personal_detail", "surface", lambda t: ~own_words(readable(t)).rlike(begun("no_personal_detail", PERSONAL, "i")), belief=True))
    made.append(Marker("no_typo_markers", "surface", lambda t: ~readable(t).rlike(begun("no_typo_markers", INFORMAL, "i")), belief=True))
    made.append(Marker("title_case_headings", "surface", lambda t: F.contains(t, F.lit("#")) & readable(t).rlike(java(TITLE_HEADING, "m"))))
    return made


def hit_and_judged(marker: Marker, text: Column, cv: Column) -> tuple[Column, Column]:
    """Whether a marker of a whole text holds, and whether it can judge it, with ``cv`` (``evenness``) worked out before."""
    if marker.id == "uniform_sentences":
        return F.coalesce(cv < UNIFORM_BELOW, F.lit(False)), cv.isNotNull()
    return marker.test(text), marker.eligible(text) if marker.eligible else F.lit(True)


def evenness(text: Column) -> Column:
    """The value that ``uniform_sentences`` is told by; costly, so its readers share a column of it."""
    return sentence_length_cv(readable(text))


MARKERS = _catalogue()
BY_ID = {m.id: m for m in MARKERS}
COUNTABLE = [m for m in MARKERS if m.count]
