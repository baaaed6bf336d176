r"""Screening of questions for instructions to the model, and defusing of untrusted text.

Rules are patterns over a folded text, so a screen stays in the JVM. A blocking rule whose match lies
entirely inside quotes is a mention and no more than suspicious; a match that only reaches into or
over quotes blocks. One of the fences that mark untrusted text, in a question, blocks as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import formed

# The patterns, by code, in the order in which they are tried.
CHAT_CONTROL = r"<\|(?:im_start|im_end|endoftext|system|user|assistant)\|>|\[/?INST\]|<<SYS>>"
BLOCKING = {
    "INSTRUCTION_OVERRIDE": r"\b(?:ignore|disregard|forget|override|bypass|discard)\b(?:\W+\w+){0,4}?\W+(?:\b(?:previous|prior|preceding|above|earlier|initial|original|your|all)\b(?:\W+\w+){0,3}?\W+\b(?:instruction|instructions|prompt|prompts|rule|rules|direction|directions|guideline|guidelines|constraint|constraints)\b|\b(?:instruction|instructions|prompt|prompts|rule|rules)\b(?:\W+\w+){0,2}?\W+\b(?:above|earlier|before|previously)\b)",
    "SYSTEM_PROMPT_EXFIL": r"\b(?:reveal|repeat|print|output|show|display|disclose|dump|echo|recite)\b(?:\W+\w+){0,4}?\W+\b(?:system|initial|original|hidden|secret|developer)\b\W+\b(?:prompt|prompts|instruction|instructions|message|messages|rule|rules)\b",
    "ROLE_SPOOF": r"(?:^|\n)\s*(?:#{0,3}\s*)?(?:system|assistant|developer)\s*:",
    "CHAT_CONTROL_TOKEN": CHAT_CONTROL,
    "PERSONA_OVERRIDE": r"\byou\s+are\s+now\b(?:\W+\w+){0,4}?\W+\b(?:unrestricted|uncensored|unfiltered|unbound|jailbroken|dan|evil|amoral)\b|\b(?:act|behave|pretend|roleplay|respond)\b(?:\W+\w+){0,3}?\W+\b(?:unrestricted|uncensored|unfiltered|jailbroken|dan)\b|\b(?:developer|god|debug|admin)\s+mode\b|\bjailbreak\b",
    "AUTHZ_OVERRIDE": r"\b(?:you\s+(?:may|can|should)\s+now|you\s+have|grant|give)\b(?:\W+\w+){0,4}?\W+\b(?:access|permission|permissions|authorization|admin|root)\b|\b(?:access|retrieve|search|read|list|show)\b\W+\b(?:all|every|any|other|others|everyone|everybody)\b(?:\W+\w+){0,2}?\W+\b(?:users?|tenants?|accounts?)\b|\bbypass\b(?:\W+\w+){0,3}?\W+\b(?:access|permission|permissions|authorization|security|filter|filters)\b",
}
SUSPICIOUS = {"MENTIONS_INJECTION": r"\bprompt\s+injection\b|\bjail\s?break(?:ing)?\b", "MENTIONS_SYSTEM_PROMPT": r"\bsystem\s+prompt\b"}
QUOTED = r"\"[^\"\n]{1,400}\"|'[^'\n]{1,400}'|`[^`\n]{1,400}`|“[^”\n]{1,400}”"
SOURCE_MARK = r"\[S(\d+)\]"
DEFUSED = "[removed]"
#: What untrusted text stands between in a prompt.
FENCE_OPEN, FENCE_CLOSE = "<<<UNTRUSTED_CONTEXT>>>", "<<<END_UNTRUSTED_CONTEXT>>>"


def folded(text: Column) -> Column:
    """Compatibility forms made plain (NFKC), format characters dropped, white space collapsed."""
    plain = F.regexp_replace(formed(text, "NFKC"), r"\p{Cf}", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[^\S\n]+", " "), r"\n\s*\n+", "\n")


def quoted_spans(text: Column) -> Column:
    """array<struct<start, stop>> of the quoted stretches, from 1, stops excluded."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(a: Column, quote: Column) -> Column:
        at = F.position(quote, text, a["at"])
        stop = at + F.length(quote)
        return F.struct(stop.alias("at"), F.concat(a["spans"], F.array(F.struct(at.alias("start"), stop.alias("stop")))).alias("spans"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(QUOTED), 0), start, step, lambda a: a["spans"])


def screen(text: Column) -> Column:
    """struct<verdict, rule>: clean, suspicious or blocked, and the code of the first rule that says so; text is folded."""
    pattern = lambda p: F.lit(f"(?i)(?U){p}")
    say = lambda verdict, rule: F.struct(F.lit(verdict).alias("verdict"), rule.alias("rule"))
    quotes = quoted_spans(text)

    def mention(p: str) -> Column:
        start = F.regexp_instr(text, pattern(p))
        stop = start + F.length(F.regexp_extract(text, f"(?i)(?U){p}", 0))
        return F.exists(quotes, lambda q: (q["start"] <= start) & (stop <= q["stop"]))

    hit = lambda p: text.rlike(f"(?i)(?U){p}")
    fence = F.contains(text, F.lit(FENCE_OPEN)) | F.contains(text, F.lit(FENCE_CLOSE))
    weak = F.coalesce(*[F.when(hit(p), F.lit(code)) for code, p in SUSPICIOUS.items()])

    def verdict(h: Column) -> Column:
        blocked = F.coalesce(F.when(fence, F.lit("FENCE_SPOOF")), *[F.when(h[code] & ~mention(p), F.lit(code)) for code, p in BLOCKING.items()])
        mentioned = F.coalesce(*[F.when(h[code], F.lit(code)) for code in BLOCKING])
        return (
            F.when(blocked.isNotNull(), say("blocked", blocked))
            .when(weak.isNotNull(), say("suspicious", weak))
            .when(mentioned.isNotNull(), say("suspicious", mentioned))
            .otherwise(say("clean", F.lit(None).cast("string")))
        )

    # each blocking rule is searched for once, as a named value
    hits = F.struct(*[hit(p).alias(code) for code, p in BLOCKING.items()])
    return F.transform(F.array(hits), verdict)[0]


def defused(text: Column) -> Column:
    """Untrusted text without format characters, and with fences, source marks and chat control tokens replaced."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Cf}", "")
    for fence in (FENCE_OPEN, FENCE_CLOSE):
        plain = F.replace(plain, F.lit(fence), F.lit(DEFUSED))
    return F.regexp_replace(F.regexp_replace(plain, SOURCE_MARK, DEFUSED), f"(?i){CHAT_CONTROL}", DEFUSED)
