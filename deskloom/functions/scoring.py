"""Vetoes, desks and scores (P05, P06, D08-D10) over items with lower-case text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions import events
from deskloom.functions import values as V
from deskloom.functions.text import ascii_edges, identifiers, let, matches, term_hits, weighted


def broad_quantity(text: Column) -> Column:
    """Whether text names an amount of money, a percentage, or a number of people or things."""
    return events.met(events.plain_edges(text), V.BROAD_QUANTITY)


def broad_impact(text: Column) -> Column:
    return matches(text, V.BROAD_IMPACT) | (F.size(identifiers(text)) > 0) | broad_quantity(text)


def is_opinion(title: Column, categories: Column) -> Column:
    return matches(title, [V.OPINION_TITLE]) | F.exists(categories, lambda c: c.rlike(ascii_edges(V.OPINION_CATEGORY)))


def vetoes(title: Column, summary: Column, categories: Column, url_path: Column, evidence: Column) -> Column:
    """The sorted codes of all vetoes that apply. evidence: whether a tentative report is borne out."""
    headline = F.concat_ws(" ", title, F.array_join(categories, " "))
    all_text = F.concat_ws(" ", title, summary, F.array_join(categories, " "))
    safe = F.regexp_replace(headline, ascii_edges(V.SAFE_REVIEW), "")
    hit = {code: matches(safe if code.startswith("REVIEW") else headline, patterns) for code, patterns in V.VETOES.items()}
    hit["PROMOTIONAL_OR_DEAL_CONTENT"] |= matches(all_text, [V.SPONSORED]) | url_path.rlike(V.SPONSORED_PATH)
    hit["SPECULATIVE_OR_RUMOR"] |= matches(headline, [V.SOFT_SPECULATION]) & ~evidence
    hit["ROUTINE_CLOUD_CAPACITY_NOTICE"] &= ~broad_impact(all_text)
    hit["OPINION_OR_COMMENTARY"] = is_opinion(title, categories)
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in hit.items()])))


#: The terms of all desks, each once; hits are arrays in this order.
TERMS = list(dict.fromkeys(t for terms in V.DESK_TERMS.values() for t in terms))


def desk_hits(text: Column, desk: str | None = None) -> Column:
    """Which of the desks' terms lower-case text has. Keep it as a column, since the scores refer to it many times.

    desk: the only one whose scores are asked for; other desks' terms, which it gives no weight, are not sought and count as missing.
    """
    if desk is None:
        return term_hits(text, TERMS)
    own = [t for t in TERMS if t in V.DESK_TERMS[desk]]
    hits = {t: i for i, t in enumerate(own)}
    return let(term_hits(text, own), lambda h: F.array(*[F.get(h, F.lit(hits[t])) if t in hits else F.lit(False) for t in TERMS]))


def strong_terms(hits: Column, desk: str) -> Column:
    """The number of a desk's strong terms among the hits."""
    return weighted(hits, [V.DESK_TERMS[desk].get(t, 0) >= V.STRONG_WEIGHT for t in TERMS]).cast("int")


def desk_scores(title: Column, summary: Column, priors: Column | None = None) -> dict[str, dict[str, Column]]:
    """D08 over desk_hits() of title and summary: for each desk the strong terms in both, eligibility and score."""
    out = {}
    for desk, terms in V.DESK_TERMS.items():
        t, s = strong_terms(title, desk), strong_terms(summary, desk)
        prior = F.lit(0.0) if priors is None else F.coalesce(F.element_at(priors, F.lit(desk)), F.lit(0.0))
        of = lambda hits, factor: weighted(hits, [terms.get(x, 0) * factor for x in TERMS])  # noqa: E731, B023
        score = F.round(prior + of(title, 1.35) + of(summary, 0.55), 2)
        out[desk] = {"title": t, "summary": s, "eligible": (t >= 1) | (s >= 2), "score": score}
    return out


def choose_desk(scores: dict[str, dict[str, Column]], title: Column) -> Column:
    """The eligible desk of the highest score, the first of equals; headlines of listings and integrations overrule."""
    place = {d: i for i, d in enumerate(scores)}
    rows = F.array(*[F.struct(c["title"].alias("title"), c["eligible"].alias("eligible"), c["score"].alias("score"), F.lit(i).alias("place"), F.lit(d).alias("desk")) for i, (d, c) in enumerate(scores.items())])
    listing = matches(title, [r"\b(?:ipo|initial public offering|go(?:ing)? public)\b"])
    joined = matches(title, [r"\b(?:integration|integrates?|available (?:on|in))\b"]) & matches(title, [r"\b(?:vercel|developer|ide|editor)\b"])

    def choose(r: Column) -> Column:
        of = lambda desk: F.get(r, F.lit(place[desk]))
        fit = F.filter(r, lambda x: x["eligible"])
        best = F.array_min(F.transform(fit, lambda x: F.struct((-x["score"]).alias("s"), x["place"].alias("i"), x["desk"].alias("d"))))
        plain = of("security-and-privacy")["title"] == 0
        event = F.when(plain & listing & of("platforms-and-power")["eligible"], "platforms-and-power").when(plain & ~listing & joined & of("work-and-tools")["eligible"], "work-and-tools")
        return F.when(F.size(fit) > 0, F.coalesce(event, best["d"]))

    return let(rows, choose)


def scorecard(text: Column, tier: Column, title_terms: Column, summary_terms: Column, desk_score: Column, fresh: Column) -> dict[str, Column]:
    """The five components; keep them as columns, then total() sums them."""
    m = V.SCORE_MAXIMA
    known, amount = (F.size(identifiers(text)) > 0).cast("int"), broad_quantity(text).cast("int")
    cap = lambda most, x: F.least(F.lit(most), x)
    lists = [V.IMPACT, V.NOVELTY, V.ACTION]  # the text's words are taken once for all
    starts = [sum(len(x) for x in lists[:i]) for i in range(len(lists))]
    number = lambda h, i: F.size(F.filter(F.slice(h, starts[i] + 1, len(lists[i])), lambda x: x))
    counts = let(term_hits(text, [t for x in lists for t in x]), lambda h: F.struct(*[number(h, i).alias(k) for i, k in enumerate(("impact", "novelty", "action"))]))
    return {
        "materiality": cap(m["materiality"], 8 + cap(16, counts["impact"] * 4) + cap(4, counts["novelty"] * 2) + known * 3 + amount * 2),
        "relevance": cap(m["relevance"], 10 + cap(6, title_terms * 3) + cap(4, summary_terms * 2) + F.when(desk_score >= 35, 2).otherwise(0)),
        "strength": F.when(tier == "corroborated", 20).when(tier == "authoritative-single", 16).otherwise(6),
        "usefulness": cap(m["usefulness"], 4 + cap(7, counts["action"] * 2) + known * 2 + amount * 2),
        "freshness": fresh,
    }


def total(*components: str) -> Column:
    """The score of a scorecard's columns, 100 at most."""
    out = F.lit(0)
    for c in components:
        out = out + F.col(c)
    return F.least(F.lit(100), out)


def gates(tier: Column, score: Column, materiality: Column, usefulness: Column, minimum: int = V.MINIMUM_SCORE, single: int | None = None, policy: str = "corroborated") -> Column:
    """Codes of the floors that a candidate misses."""
    single = minimum if single is None else single
    accepted = tier.isin("corroborated", *(["authoritative-single"] if policy != "corroborated" else []))
    lone = tier == "authoritative-single"
    floor = F.when(lone, single).otherwise(minimum)
    low = lone & ((materiality < 20) | ((materiality < 24) & (usefulness < 8)))
    return F.array_compact(
        F.array(
            F.when(~accepted, F.lit("INSUFFICIENT_SOURCE_EVIDENCE")),
            F.when(score < floor, F.lit("BELOW_EDITORIAL_THRESHOLD")),
            F.when(low, F.lit("AUTHORITATIVE_SINGLE_COMPONENT_FLOOR")),
        )
    )


#: Reasons that a review of the two components may lift.
SOFT_REASONS = ["BELOW_EDITORIAL_THRESHOLD", "AUTHORITATIVE_SINGLE_COMPONENT_FLOOR"]


def rescored(reasons: Column, tier: Column, parts: dict[str, Column], materiality: Column, usefulness: Column, policy: str) -> tuple[Column, Column]:
    """The score with two components replaced, and the reasons with the soft ones judged anew."""
    kept = F.filter(reasons, lambda r: ~r.isin(SOFT_REASONS))
    score = F.least(F.lit(100), materiality + usefulness + parts["relevance"] + parts["strength"] + parts["freshness"])
    return score, F.array_distinct(F.concat(kept, gates(tier, score, materiality, usefulness, policy=policy)))
