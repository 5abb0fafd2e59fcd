"""Caveats of a source that a claim loses (T21), clause by clause.

Both texts are cut into clauses. A clause asserts what a pattern says if one of its matches stands in no scope of negation or
doubt: no such words before it in the clause, none after it. A caveat that a later clause of the source takes back is none.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.events import plain_edges
from deskloom.functions.text import let, nfkc, single_spaces

# Where clauses end.
CLAUSE_ENDS = r"(?i)(?=[.\s])(?:(?<=[!?;])\s+|(?<!\d)\.\s+|(?<=\d)\.(?!\d)\s+|\s+(?:but|however|nevertheless)\s+)"
# The scopes of negation and doubt around what a clause says.
NEGATED_BEFORE = r"(?i)\b(?:no|not|never|neither|without|cannot|can't|doesn't|does not|didn't|did not|hasn't|has not|haven't|have not|isn't|is not|wasn't|was not|aren't|are not|weren't|were not|couldn't|could not|wouldn't|would not)\b[^.!?;]{0,100}$"
DOUBTED_BEFORE = r"(?i)\b(?:watch(?:ing)?|monitor(?:ing)?|check(?:ing)?|whether|if|could|might|may|would|possible|potential|risk of|prevent(?:ing)?)\b[^.!?;]{0,75}$"
DOUBTED_AFTER = r"(?i)^.{0,45}\b(?:unknown|unconfirmed|unverified|not (?:known|confirmed|established|reported)|has not been (?:confirmed|established|reported))\b"
# A boot control that is off, what runs before the system, and wordings that make the one a condition of the other or not.
BOOT_OFF = r"\b(?:secure boot\s+(?:(?:is|was|has been|to be|must be|needs to be|would need to be)\s+)?(?:disabled|off|not enabled)|(?:disable(?:d)?|turn(?:ed)? off)\s+secure boot|without\s+(?:enabled\s+)?secure boot)\b"
BOOT_EXECUTION = r"\b(?:(?:arbitrary\s+)?(?:uefi(?:-level)?|firmware|pre-boot|preboot)\s+(?:(?:level|arbitrary)\s+)?(?:code\s+)?execut(?:e|ion)|execut(?:e|ing|ion of)\s+(?:arbitrary\s+)?(?:uefi(?:-level)?|firmware|pre-boot|preboot)\s+code|code\s+(?:execution|execut(?:es|ed))\s+(?:before|prior to)\s+(?:the\s+)?(?:operating system|os)\b|execut(?:e|ing)\s+(?:arbitrary\s+)?code\s+(?:before|prior to)\s+(?:the\s+)?(?:operating system|os)\b|(?:code execution|execut(?:e|ing)\s+(?:arbitrary\s+)?code)\s+(?:at|in|within)\s+(?:the\s+)?(?:uefi|firmware)(?:\s+level)?)"
ELSEWHERE = r"(?i)\b(?:on|for|in)\s+(?:(?:an?|the)\s+)?(?:other|another|different|unrelated)\b"
NOT_REQUIRED = r"(?i)\b(?:not|never|doesn't|needn't)\s+(?:[a-z]+\s+){0,2}(?:require|need)\s*$"
OR_ENABLED = r"(?i)^\s*,?\s*(?:or|and|/)\s+(?:(?:with\s+)?secure boot\s+)?(?:enabled|on)\b"
CONDITION_BEFORE = r"(?i)\b(?:when|if|with|requires?|needs?)\s+(?:the\s+)?$"
MUST_BE = r"(?i)\b(?:must be|needs to be|would need to be)\b"
CONDITION_AFTER = r"(?i)^\s+(?:for|to|before)\b"
REFERS_BACK = r"(?i)^(?:it|this|that|the exploit|the attack|this impact|this capability)\b"
# Exploitation that is known or not, fixes that exist or not, and what makes a caveat a thing of the past.
EXPLOITED = r"\b(?:actively exploit(?:ed|ing)|exploit(?:ed|ing|ation)\s+(?:(?:the|this)\s+(?:flaw|bug|issue|vulnerability)\s+)?(?:in\s+)?(?:the\s+)?(?:wild|real[- ]world)|(?:exploitation|attacks)\s+(?:(?:has|have|is|are|was|were|been|being|now)\s+){0,4}(?:observed|reported|detected|confirmed|ongoing|occurred)|(?:known|confirmed|observed|reported|ongoing)\s+(?:active\s+)?exploitation|used\s+in\s+(?:real[- ]world\s+)?attacks|(?:attackers?|threat actors?)\s+(?:(?:are|were|have|has|had|been)\s+){1,3}(?:(?:actively|currently)\s+)?exploit(?:ed|ing))\b"
EXPLOITATION_UNKNOWN = r"\b(?:(?:no|without)\s+(?:(?:known|confirmed|reported|observed|public|credible)\s+)*(?:evidence|reports?)\s+(?:of|for|that)\s+.{0,90}(?:exploitation|exploited|exploiting|attacks?)|(?:does not|did not|has not|cannot|can't|could not|hasn't)\s+(?:establish|confirm|identify|report|verify)\s+.{0,70}(?:exploitation|exploited|exploiting|attacks?)|(?:not|never)\s+(?:aware|heard)\s+of\s+.{0,50}(?:exploitation|exploited|exploiting|attacks?)|(?:no|not)\s+(?:(?:known|confirmed|observed|reported|active)\s+)*(?:exploitation|attacks)|exploitation\s+(?:status\s+)?(?:is\s+|remains\s+)?(?:unknown|unconfirmed|unverified)|exploitation\s+(?:has|have)\s+not\s+been\s+(?:reported|confirmed|observed|established))\b"
NO_FIX = r"\b(?:(?:no|without)\s+(?:(?:known|available|released|official)\s+)*(?:fix|patch|remediation)\b|(?:fix|patch|remediation)\s+(?:is|was|remains)\s+(?:not available|unavailable|unreleased)|(?:fix|patch)\s+has\s+not\s+been\s+(?:released|issued))\b"
FIX_OUT = r"\b(?:(?:fix|patch|remediation|corrected driver)\s+(?:(?:is|was|has|have|been|now|already)\s+){0,4}(?:available|released|issued|published)|(?:released|issued|published)\s+(?:a\s+|the\s+|an?\s+)?(?:fix|patch|corrected driver)|(?:vendor|developer)\s+(?:has\s+)?(?:fixed|patched|resolved)\s+(?:the\s+)?(?:issue|bug|vulnerability))\b"
PAST = r"(?i)\b(?:at disclosure|at publication|at the time|initially|previously|formerly|originally|had (?:been|not)|was not|were not|was unavailable)\b"
SINCE = r"(?i)\b(?:now|today|later|subsequently|since then|updated?|newly)\b"
# Versions that fix, and versions to update to.
_VERSION = r"(\d+(?:\.\d+){1,3})"
FIXED_IN = [
    rf"\b(?:fix(?:ed|es)?|patch(?:ed|es)?|resolv(?:ed|es)?|correct(?:ed|s)?|remediat(?:ed|es)?)\b.{{0,45}}?\b(?:v(?:ersion)?\s*)?{_VERSION}\b",
    rf"\b(?:v(?:ersion)?\s*)?{_VERSION}\b.{{0,45}}?\b(?:fixes|patches|resolves|corrects|remediates|(?:is|was)\s+(?:the\s+)?(?:fixed|patched|corrected)\s+(?:version|release))\b",
]
UPDATE_TO = rf"\b(?:update|upgrade)\s+(?:(?:the|your)\s+)?(?:[a-z][a-z0-9_-]*\s+){{0,5}}to\s+(?:version\s+|v)?{_VERSION}\b"
# What is on by default, and for which organizations; apps to download, and claims that none need be.
BY_DEFAULT = r"\b(?:(?:enabled|on|active|activated|available)\s+by\s+default|default[- ](?:on|enabled)|automatically\s+(?:enabled|activated))\b"
ASKED_BEFORE = r"(?i)\b(?:whether|if)\b[^,;.!?]{0,75}$"
ENABLED_FOR = r"\b(?:organizations?|orgs?|tenants?)\s+(?:with|where|that)\s+(?:already\s+)?(?:have\s+)?([a-z][a-z0-9]*(?:[ -][a-z][a-z0-9]*){0,5}?)\s+(?:(?:is|has been)\s+)?(?:already\s+)?enabled\b"
EVERYONE = r"(?i)\b(?:personal\s+(?:google\s+)?(?:users?|accounts?)|everyone|regardless\s+of|all\s+(?:eligible\s+)?(?:google\s+workspace\s+)?accounts?)\b"
OTHERS = r"(?i)\b(?:other|another|different|unrelated)\b"
OTHERS_AFTER = r"(?i)^\s+(?:on|for|in)\s+(?:an?\s+)?(?:other|another|different|unrelated)\b"
QUALIFIES = r"(?i)\b(?:for|in|within|at|if|when)\s+(?:(?:all|the|those|your)\s+)?$"
DOWNLOAD = r"(?i)\b(?:download|install)\s+(?:(?:the|a|your)\s+)?(?:[a-z][a-z0-9-]*\s+){0,5}(?:app|application|client)\b"
BYPASS = r"\b(?:pre[- ]?installed|(?:already|automatically)\s+installed|(?:no|without(?:\s+(?:any|a))?)\s+(?:download(?:ing)?|install(?:ation|ing)?)(?:\s+(?:or|and)\s+(?:download(?:ing)?|install(?:ation|ing)?))?(?:\s+(?:is\s+)?(?:needed|required))?|(?:does\s+not|doesn't|need\s+not|needn't)\s+(?:require\s+)?(?:a\s+)?(?:download|install(?:ation)?))\b"
APP = r"(?i)\b(?:app|application|client)\b"


#: One of these stands in whatever a rule below looks for; the other clauses only keep their places.
_WORDS = [
    "exploit", "attack", "fix", "patch", "remediat", "correct", "resolv", "update", "upgrade", "driver", "secure boot", "execut", "default", "automatically", "install", "download",
]


def clauses(text: Column) -> Column:
    """The clauses of a text in compatibility form, in order; contrasts begin clauses of their own, points within numbers don't.

    Clauses without any word of the rules are empty, so that no rule finds anything in them.
    """
    straight = F.replace(F.replace(nfkc(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'")), F.lit("‘"), F.lit("'"))
    parts = F.filter(F.transform(F.split(plain_edges(F.trim(single_spaces(straight))), CLAUSE_ENDS, -1), F.trim), lambda c: c != "")
    some = lambda low: reduce(or_, [low.contains(w) for w in _WORDS])
    return F.transform(parts, lambda c: F.when(let(F.lower(c), some), c).otherwise(""))


def occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in a text, in order, as (before, found, after); found is the group's text, or the whole match."""
    whole = F.lit("(?i)" + pattern)
    gaps = F.split(text, "(?i)" + pattern, -1)
    found = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(0)).alias("all"), F.regexp_extract_all(text, whole, F.lit(group)).alias("group"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"]["all"])
        one = F.struct(F.substring(text, F.lit(1), start).alias("before"), x["hit"]["group"].alias("found"), F.substring(text, end + 1, F.length(text)).alias("after"))
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<before:string,found:string,after:string>>").alias("out"))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, zero, step, lambda held: held["out"])


def assertions(clause: Column, pattern: str, group: int = 0, doubt: bool = False, beside: str | None = None) -> Column:
    """The occurrences that stand in no scope of negation or, unless doubt may be, of doubt. beside: words that open no scope."""

    def stands(x: Column) -> Column:
        before = x["before"] if beside is None else F.regexp_replace(x["before"], f"(?i)^(.*?)(?:{beside})", "$1")
        out = ~before.rlike(NEGATED_BEFORE) & ~x["after"].rlike(DOUBTED_AFTER)
        return out if doubt else out & ~before.rlike(DOUBTED_BEFORE)

    return F.filter(occurrences(clause, pattern, group), stands)


def asserts(clause: Column, pattern: str, doubt: bool = False, beside: str | None = None) -> Column:
    # most clauses have no match, and their scopes need no look
    return clause.rlike("(?i)" + pattern) & (F.size(assertions(clause, pattern, 0, doubt, beside)) > 0)


def _boots(clause: Column) -> Column:
    return asserts(clause, BOOT_EXECUTION, doubt=True, beside=BOOT_OFF)


def _boot_condition(clause: Column) -> Column:
    """Whether a clause makes it a condition that the boot control is off; a mention alone, or one of another machine, does not."""

    def condition(x: Column) -> Column:
        other = x["after"].rlike(ELSEWHERE) | x["before"].rlike(NOT_REQUIRED) | x["after"].rlike(OR_ENABLED)
        said = x["found"].rlike(r"(?i)^without\b") | x["before"].rlike(CONDITION_BEFORE) | (x["found"].rlike(MUST_BE) & x["after"].rlike(CONDITION_AFTER))
        return ~other & said

    return clause.rlike("(?i)" + BOOT_OFF) & let(F.get(occurrences(clause, BOOT_OFF), F.lit(0)), condition)


def _needs_boot_off(source: Column) -> Column:
    """Whether a clause, or one and the next that refers back to it, has what runs before the system on that condition."""
    beside = F.transform(source, lambda c, i: F.struct(c.alias("c"), F.when(i > 0, F.get(source, i - 1)).alias("last"), F.get(source, i + 1).alias("next")))

    def conditional(x: Column) -> Column:
        back = (x["next"].rlike(REFERS_BACK) & _boots(x["next"])) | (x["c"].rlike(REFERS_BACK) & _boots(x["last"]))
        return _boot_condition(x["c"]) & (_boots(x["c"]) | F.coalesce(back, F.lit(False)))

    return F.exists(beside, lambda x: F.coalesce(conditional(x), F.lit(False)))


def _open(source: Column, caveat: str, answer: str) -> Column:
    """Whether the source's last clause with a caveat is not answered by a later one that says so of now, or of a caveat of then."""
    last = F.array_max(F.transform(source, lambda c, i: F.when(c.rlike("(?i)" + caveat), i)))

    def left(at: Column) -> Column:
        past = F.get(source, at).rlike(PAST)
        later = F.slice(source, at + 2, F.size(source))
        return ~F.exists(later, lambda c: asserts(c, answer) & (past | c.rlike(SINCE)))

    return let(last, lambda at: at.isNotNull() & F.coalesce(left(F.coalesce(at, F.lit(0))), F.lit(False)))


def _versions(text: Column, patterns: list[str], doubt: bool) -> Column:
    found = [F.flatten(F.transform(F.filter(text, lambda c: c.rlike(r"\d\.\d")), lambda c: F.transform(assertions(c, p, 1, doubt), lambda x: x["found"]))) for p in patterns]
    return F.array_distinct(F.concat(*found))


def _by_default(clause: Column) -> Column:
    return clause.rlike("(?i)" + BY_DEFAULT) & F.exists(assertions(clause, BY_DEFAULT, 0, doubt=True), lambda x: ~x["before"].rlike(ASKED_BEFORE))


def _keeps_scope(clause: Column, names: Column) -> Column:
    """Whether a clause says for which organizations, those of the source, something is on."""

    def scoped(x: Column) -> Column:
        near = F.right(x["before"], F.lit(45))
        return F.array_contains(names, F.lower(x["found"])) & ~near.rlike(OTHERS) & ~x["after"].rlike(OTHERS_AFTER) & x["before"].rlike(QUALIFIES)

    return ~clause.rlike(EVERYONE) & F.exists(occurrences(clause, ENABLED_FOR, 1), scoped)


def lost_caveats(claim: Column, source: Column) -> Column:
    """The codes of caveats in source that claim contradicts, in the order of the rules; none if either text is missing."""

    def codes(x: Column) -> Column:
        mine, theirs = x["claim"], x["source"]
        says = lambda pattern: F.exists(mine, lambda c: asserts(c, pattern))
        rules = [
            ("CAVEAT_SECURE_BOOT_REQUIRED", F.exists(mine, lambda c: _boots(c) & ~F.coalesce(_boot_condition(c), F.lit(False))) & _needs_boot_off(theirs)),
            ("CAVEAT_EXPLOITATION_UNKNOWN", says(EXPLOITED) & _open(theirs, EXPLOITATION_UNKNOWN, EXPLOITED)),
            ("CAVEAT_FIX_UNAVAILABLE", says(FIX_OUT) & _open(theirs, NO_FIX, FIX_OUT)),
            (
                "CAVEAT_FIX_VERSION_UNSUPPORTED",
                (F.size(F.array_except(_versions(mine, FIXED_IN, True), _versions(theirs, FIXED_IN, False))) > 0)
                | (F.size(F.array_except(_versions(mine, [UPDATE_TO], True), _versions(theirs, [*FIXED_IN, UPDATE_TO], False))) > 0),
            ),
            ("CAVEAT_DEFAULT_ENABLEMENT_SCOPE", let(_conditions(theirs), lambda names: (F.size(names) > 0) & F.exists(mine, lambda c: _by_default(c) & ~_keeps_scope(c, names)))),
            ("CAVEAT_INSTALLATION_REQUIRED", F.exists(theirs, lambda c: c.rlike(DOWNLOAD)) & F.exists(mine, lambda c: c.rlike(APP) & asserts(c, BYPASS))),
        ]
        return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))

    return let(F.struct(clauses(claim).alias("claim"), clauses(source).alias("source")), codes)


def _conditions(source: Column) -> Column:
    """The names of what organizations must have enabled, in clauses that say that something is on by default."""
    return F.flatten(F.transform(F.filter(source, _by_default), lambda c: F.transform(occurrences(c, ENABLED_FOR, 1), lambda x: F.lower(x["found"]))))
