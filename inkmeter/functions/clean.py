"""Checks on a text: did it finish, is it English, is it the text that was asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE, java
from .tokens import approx_tokens, let, letter_runs, loop_words

# ---- fixed values: word lists, caps and patterns of the checks ----
FUNCTION_WORDS = ["the", "and", "to", "i", "a", "of", "is", "it", "that", "in", "my", "you", "for", "this", "with", "was", "but", "have", "on", "be", "we", "are", "as", "by", "an", "or", "not", "from", "at", "which"]
ENGLISH_FROM = 0.12
CAPS = {"chatgpt": 470.0, "gpt4": 470.0, "llama-chat": 330.0, "mistral-chat": 330.0, "claude": float("inf"), "llama3": 1300.0}
STOPPED = r"[.!?…。！？‼⁉](?:[\"'”’»)\]}*_]|\s)*$"
FINISHED = [
    r"\p{Extended_Pictographic}[\u{FE0E}\u{FE0F}\u{1F3FB}-\u{1F3FF}\u{200D}\u{20E3}]*[\"'”’)\]]*\s*$",
    r"(?:^|\s)(?:[:;=8xX]-?[)(DPpOo3\]\[|/\\]+|<3+|\^_?\^|[Tt]_[Tt])\s*$",
    r"(?:^|\s)#[\p{L}\p{N}_]+\s*$",
    r"[\])}]\s*$",
    r"https?:\/\/\S+\s*$",
    r"(?:^|\s)(?:-{3,}|\*{3,}|_{3,})\s*$",
]
SIGN_OFF = r"(?:^|[.!?…][\"'”’)]*\s+)(?:thanks|thank you|many thanks|cheers|best|best wishes|regards|best regards|kind regards|warm regards|sincerely|yours|yours truly|love|peace|take care|stay safe|all the best|xoxo|hugs)(?:\s+[^\s,.!?]+){0,4}\s*,\s*(?:[^\s.!?,]+\s+){0,3}([^\s.!?,]+)$"
SIGNATURE = r"[.!?…][\"'”’)]*\s+(?:[A-Z][\p{L}'’-]*\s+){0,2}([A-Z][\p{L}'’-]*)$"
NOT_A_NAME = "A|An|The|And|Or|But|Of|To|In|On|At|For|With|From|By|As|If|So|My|Your|Our|Their|His|Her|Its|This|That|These|Those|I|We|You|They|He|She|It|There|Here|When|While|Because|Although|Every|Each|Some|Any|No|Not|Is|Are|Was|Were|Be|Have|Has|Had|Do|Does|Did|Can|Could|Will|Would|Should|May|Might|Must|Also|Then|Than|Just|Even|Still|After|Before|Since|Until|Unless|Whether|What|Which|Who|Where|How|Why".split("|")
INSIDE_A_CLAUSE = r"(?:[,;:(\[{“‘\-–—/&+=]|\p{L}['’])\s*$"
BARE_LIST_MARKER = r"(?:^|\n|[.!?][\"'”’)\]]*[^\S\n]+)[^\S\n]*(?:\d{1,2}[.)]|[*•+])\s*$"
META_OPENING = 300
#: kind, where it is looked for, pattern, flags; the first that matches names the kind
META = [
    ("refusal", "start", r"\bI(?:['’]m| am)?\s*(?:cannot|can['’]?t|can not|will not|won['’]t|(?:am |['’]m )?(?:not able|unable) to)\s+(?:provide|fulfil+|create|generate|assist|comply|complete|write|answer|respond|help with|engage|produce|continue)\b[\s\S]{0,160}?(?:\b(?:request|prompt|body of|reddit post|this post|a response|appropriate|inappropriate|harmful|offensive|ethical|unethical|policy|policies|guidelines|programming|language model|guidance|information (?:or|on|about)|without (?:the|more|any|additional) (?:title|context|information|details))\b|\bAI\b|\b(?:with|fulfil+) (?:that|this)(?: request)?\s*[.!]?\s*$)", "i"),
    ("refusal", "start", r"^\W*I apologi[sz]e,? but\b", "i"),
    ("assistant", "anywhere", r"\bI(?:['’]m| am) (?:just |only )?an? (?:AI|artificial intelligence|language model|chatbot|virtual assistant)\b|\bas an? (?:responsible )?(?:AI|artificial intelligence)(?: language model| assistant)?\s*,", "i"),
    ("assistant", "start", r"^\W*(?:I['’]m|I am) (?:so |very |really )?sorry to hear (?:that|about)\b", "i"),
    ("assistant", "start", r"^\W*(?:sure|certainly|of course|absolutely)\s*[,!.]?\s*(?:I can (?:help|write|create|provide|give)|I['’]d be (?:happy|glad) to|I (?:will|['’]ll) (?:write|create|provide|help)|let me (?:write|create|provide|help|explain))\b", "i"),
    ("assistant", "start", r"^\W*I understand (?:that )?you(?:['’]re| are| want| may| might| would| have)\b", "i"),
    ("assistant", "start", r"^\W*(?:I (?:don['’]t|do not) think (?:it['’]?s|it is)|(?:it['’]?s|it is) not) (?:appropriate|respectful|accurate|fair)(?: or \w+)? to (?:suggest|say|assume|imply|ask|claim)\b", "i"),
    ("assistant", "anywhere", r"\bI must (?:remind you|advise against|caution (?:you|against))\b|\bI (?:would|['’]d) (?:like to )?(?:advise|caution) against\b", "i"),
    ("preamble", "start", r"^\W*(?:sure|certainly|of course|absolutely|okay|ok|alright)\b[^\n]{0,40}?\bhere(?:['’]s| is| are)\b", "i"),
    ("preamble", "start", r"^\W*(?:I['’]m|I am|I['’]d be|I would be) (?:happy|glad) to help(?: you)?(?: with (?:that|this))?\s*[!.,]?\s+here(?:['’]s| is| are)\b", "i"),
    ("preamble", "start", r"^\W*here(?:['’]s| is| are)\s+(?:(?:a|an|the|my|your)\s+)?(?:possible |sample |potential |draft |revised |suggested )?(?:body|reddit post|post|abstract|response|version|draft)\b[^\n]{0,100}?:", "i"),
    ("preamble", "anywhere", r"\bhere(?:['’]s| is) (?:a |an |the |my )?(?:possible |sample |potential |draft |revised |suggested )?(?:body|reddit post|abstract)\b[^\n.]{0,100}:", "i"),
    ("preamble", "start", r"^\W*(?:the|an?|this)\s+(?:possible |sample |potential |hypothetical )?abstract\s+(?:for|of)\s+(?:the|an?|this)\s+(?:academic\s+|research\s+|scientific\s+)?(?:paper|article|study)\b", "i"),
    ("preamble", "anywhere", r"\bhere(?:['’]s| is) (?:an? )?(?:example|sample|possible \w+|draft) of (?:an? |the |what (?:the|an?) )?abstract\b", "i"),
    ("description", "anywhere", r"\b(?:the|this|an?|its) abstract (?:would|will|should|could|might|may) (?:likely |probably |typically |also )?(?:describe|discuss|include|provide|present|focus|cover|summari[sz]e|highlight|outline|explain|begin|start|mention|detail)\b|\bthe (?:paper|article|study) would (?:likely|probably)\b", "i"),
    ("description", "anywhere", r"\bis an? academic (?:paper|article)\b|\b(?:the|this|an?) (?:academic )?(?:paper|article|study) (?:(?:titled|entitled)\s*)?[\"“]", "i"),
    ("label", "start", r"^[\W_]*(?:title|body|post|post body|subject|reddit post|abstract|headline)\s*[*_]*\s*:", "i"),
    ("label", "anywhere", r"(?:^|\n)[\W_]*(?:title|body)\s*[*_]*\s*:", "i"),
    ("label", "anywhere", r"[.!?;\"”:]\s+(?:Title|Body)\s*:|\b(?:Abstract|ABSTRACT)\s*:", ""),
    ("note", "anywhere", r"\(\s*note\s*:|\bI hope (?:this|that|the) (?:post |response |draft |text |abstract )?(?:meets|fits|matches|is what you)\b|\blet me know if you(?:['’]d| would)? (?:like|want|need) (?:me to|any (?:changes|modifications|revisions|adjustments|edits)|anything else)\b|\bfeel free to (?:modify|adjust|edit|customi[sz]e|tweak|change) (?:it|this|the (?:post|text|draft))\b", "i"),
    ("placeholder", "unsigned", r"\[(?:your|insert|add|optional|end of|link|image|photo|screenshot|username|user name)\b[^\]\n]{0,80}\](?!\()|\[[^\]\n]{0,40}\b(?:name|username|link|insert|here)\](?!\()", "i"),
    ("placeholder", "unsigned", r"\[(?!(?:deleted|removed|oc|serious|nsfw|spoiler|spoilers|update|edit|meta|discussion|question|help|advice|sic|ref|pc|ps4|ps5|xbox|us|uk|eu|na|long|rant|vent|request|original|repost|x|tw|cw)\])[a-z][a-z' ]{1,30}\](?!\()", ""),
]
SIGNATURE_TAIL = r"\n[ \t]*(?:sincerely|sincerely yours|best|best regards|best wishes|regards|kind regards|warm regards|thank you|thanks|yours truly|yours sincerely|respectfully|respectfully yours)[,.!]?[ \t]*\n[\s\S]{0,120}$"
# ---- end of the fixed values ----
#: By place in ``META``: where a match begins, looked for first; it spares the word boundaries elsewhere.
META_BEGINS = {
    2: "(?=i(?:['’]m| am) |as an? )", 7: "(?=i (?:must|would|['’]d) )", 11: "(?=here)", 13: "(?=here)", 14: "(?=(?:the|this|an?|its) abstract |the (?:paper|article|study) )",
    15: "(?=is an? |(?:the|this|an?) (?:academic|paper|article|study) )", 18: r"(?=[.!?;\"”:]\s+[TB]|A)", 19: r"(?=\(|i hope |let me |feel free )",
}
#: Code points of a text's end in which its last words are looked for first, and of its beginning in which its tokens are counted first.
TAIL, HEAD = 2_000, 10_000


def trim(text: Column) -> Column:
    return F.when(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(f"[{SPACE}]"), F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(text)


def trim_end(text: Column) -> Column:
    return F.when(F.right(text, F.lit(1)).rlike(f"[{SPACE}]"), F.regexp_replace(text, rf"[{SPACE}]+\z", "")).otherwise(text)


def english_share(text: Column) -> Column:
    """Share of a text's letter runs that are common English words; 0 without letters."""
    return let(letter_runs(F.lower(text)), lambda t: F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: w.isin(FUNCTION_WORDS))) / F.size(t)).otherwise(0.0))


def is_english(text: Column) -> Column:
    return english_share(text) >= ENGLISH_FROM


def ends_in_loop(text: Column) -> Column:
    """Whether the text ends in copies of up to 12 words, the last one perhaps cut short.

    A tail of period n, at least three copies and twelve words long, that ends
    ``cut`` words before the end, equals itself moved by n words.
    """

    def looped(w: Column) -> Column:
        out = F.lit(False)
        for n in range(1, 13):
            length = n * max(3, -(-12 // n))
            for cut in range(n):
                first = F.size(w) - (cut + length) + 1
                same = F.slice(w, first, F.lit(length - n)) == F.slice(w, first + n, F.lit(length - n))
                out = out | ((F.size(w) >= cut + length) & F.when(F.size(w) >= cut + length, same).otherwise(False))
        return out

    # 23 words before the last decide for the longest case; the tail keeps the test independent of length
    last = lambda w: F.slice(w, F.greatest(F.size(w) - 46, F.lit(1)), F.lit(47))
    # the first words of the text's end may be cut, so they must not be among the 47
    tail = let(loop_words(F.right(text, F.lit(TAIL))), lambda w: F.when(F.size(w) >= 49, last(w)).otherwise(let(loop_words(text), last)))
    return let(tail, looped)


def finished_ending(text: Column) -> Column:
    """stop, symbol, signature or null: how the ending is a finished one."""
    return let(trim_end(text), _finished)


def _finished(t: Column) -> Column:
    symbol = F.lit(False)
    for p in FINISHED:
        symbol = symbol | t.rlike(java(p, "u"))

    def names(pattern: str, flags: str) -> Column:
        return F.regexp_extract(t, java(pattern, flags), 1)

    name = F.when(t.rlike(java(SIGN_OFF, "iu")), names(SIGN_OFF, "iu")).when(t.rlike(java(SIGNATURE, "u")), names(SIGNATURE, "u"))
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.char_length(name)))
    return (
        F.when(t == "", None)
        .when(t.rlike(java(STOPPED, "u")), "stop")
        .when(symbol, "symbol")
        .when(t.rlike(java(INSIDE_A_CLAUSE, "u")), None)
        .when(name.isNotNull() & ~capital.isin(NOT_A_NAME), "signature")
    )


def ends_inside_quote(text: Column) -> Column:
    """Whether the last quotation or bracket is an opening one."""
    return let(trim_end(text), _inside_quote)


def _inside_quote(t: Column) -> Column:
    def last(mark: str) -> Column:
        return F.char_length(F.substring_index(t, mark, -1))

    curly = F.when(F.contains(t, F.lit("“")), ~F.contains(t, F.lit("”")) | (last("“") < last("”"))).otherwise(False)
    opens, closes = java(r"\((?=[\p{L}\p{N}\"“'‘])"), java(r"(?=\))(?<!(?:^|\s)[:;=8xX]-?)\)")

    def place(pattern: str) -> Column:
        return let(F.split(t, pattern, -1), lambda parts: F.when(F.size(parts) > 1, F.char_length(t) - F.char_length(F.element_at(parts, -1))).otherwise(0))

    bracket = F.contains(t, F.lit("(")) & (place(opens) > place(closes))
    odd = F.regexp_count(t, F.lit('"')) % 2 == 1
    straight = odd & t.rlike(java(r"(?:^|[\s(\[])\"[\p{L}\p{N}][^\"]*$"))
    return curly | bracket | straight


def cap(model: Column) -> Column:
    """The length from which a model's text may have met its cap; the lowest for unknown models."""
    out = F.lit(min(CAPS.values()))
    for name, at in CAPS.items():
        out = F.when(model == name, F.lit(at)).otherwise(out)
    return out


def reaches_cap(text: Column, model: Column) -> Column:
    """Whether a text has as many tokens as its model's cap; counted over its beginning first, for more text has no fewer tokens."""
    at = cap(model)
    begun = (F.char_length(text) > HEAD) & (approx_tokens(F.substring(text, 1, HEAD)) >= at)
    return F.when((at == float("inf")) | (F.char_length(text) < at), False).otherwise(begun | (approx_tokens(text) >= at))


def is_truncated(text: Column, model: Column) -> Column:
    def truncated(t: Column) -> Column:
        long = reaches_cap(t, model)
        return (
            F.when(t == "", True)
            .when(ends_in_loop(t), True)
            .when(t.rlike(java(BARE_LIST_MARKER)), True)
            .when(_finished(t).isNotNull(), long & _inside_quote(t))
            .when(t.rlike(java(INSIDE_A_CLAUSE, "u")), True)
            .otherwise(long)
        )

    return let(trim_end(text), truncated)


def meta_kind(text: Column) -> Column:
    """The kind of task talk that a text holds, by the first rule that matches, or null."""

    def kind_of(t: Column, start: Column) -> Column:
        against = {"start": start, "anywhere": t, "unsigned": F.regexp_replace(t, java(SIGNATURE_TAIL, "i"), "\n")}
        out = None
        for i, (kind, where, pattern, flags) in enumerate(META):
            match = against[where].rlike(java(f"{META_BEGINS[i]}(?:{pattern})" if i in META_BEGINS else pattern, flags))
            out = F.when(match, kind) if out is None else out.when(match, kind)
        return out

    return let(trim(text), lambda t: let(F.substring(t, 1, META_OPENING), lambda start: kind_of(t, start)))
