"""Label normalisers: ordered keyword buckets and the closed codebook with its constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterloom.functions.text import nfkc, tokenize_multi, utrim

# Buckets with the substrings that lead to them, in order of precedence.
THEME_RULES = """
Finance/Crypto: crypto|token|coin|airdrop|ido|staking|defi|exchange|market|finance|econom
Public health & medicine: health|covid|vaccine|vaccination|medicine|medical|clinical|disease|pandemic|public health|hospital
Politics: politic|election|parliament|congress|senate|government|president|minister|policy|war|conflict|ukraine|russia
Crime & public safety: crime|criminal|terror|shooting|police|public safety|fraud|scam
Gaming/Gambling: gaming|gambling|casino|betting|lottery|poker
Sports: sport|football|soccer|basketball|tennis|nba|nfl
Technology: technology|tech|software|app |platform|ai | a\\.i\\.|machine learning|blockchain|internet|social media|algorithm|science|research|study
Lifestyle & well-being: lifestyle|well-being|wellbeing|culture|entertainment|media|celebrity|social issues|society|family|community
News/Information: news|headline|breaking|coverage|roundup|update
Conversation/Chat/Other: comment|conversation|chat|q&a|ama|ask me anything
Other theme:
"""
CLAIM_RULES = """
No substantive claim: no substantive claim
Verifiable factual statement: verifiable factual statement|reportage|study
Rumour / unverified report: rumour|rumor|unverified
Misleading context / cherry-picking: misleading context|cherry-picking
Promotional hype / exaggerated profit guarantee: promotional hype|exaggerated profit
Emotional appeal / fear-mongering: emotional appeal|fear-mongering|fear mongering
Scarcity/FOMO tactic: scarcity|fomo
Statistics: statistic
Fake content: fake content|fabricated
Speculative forecast / prediction: predict|forecast
Announcement: announcement
Opinion / subjective statement: opinion|interpretive|analysis|review
None / assertion only: assertion only
Other claim type:
"""
CLAIM_RULES_ABLATION = """
Verifiable factual statement: verifiable|factual
Rumour / unverified report: rumour|unverified
Misleading context / cherry-picking: misleading context|cherry
Promotional hype / exaggerated profit guarantee: promotional hype|exaggerated profit
Emotional appeal / fear-mongering: emotional appeal|fear-mongering|fear mongering
Scarcity/FOMO tactic: scarcity|fomo
Statistics: statistic
Fake content: fake content|fabricated
Speculative forecast / prediction: predict|forecast
Announcement: announcement
Opinion / subjective statement: opinion|interpretive|analysis|review
None / assertion only: assertion only
No substantive claim: [^\\s\\S]
Other claim type:
"""
CTA_RULES = """
No CTA: ^none$|no cta
Engage/Ask questions: engage|ask|anything
Attend event / livestream: attend|event|livestream|live stream
Join/Subscribe: join|subscribe|follow|whitelist
Buy / invest / donate: buy|invest|donate|stake|swap
Share / repost / like: share|repost|like
Visit external link / watch video: visit|read|watch|link|website|check|view charts
Other CTA:
"""
EVIDENCE_RULES = """
Statistics: statistic
Quotes/Testimony: quote|testimony
Chart / price graph / TA diagram: chart|graph|diagram
None / assertion only: assertion only
Other (Evidence):
"""

# The reduced tables of the baseline run; labels are matched by substring only.
THEME_RULES_REDUCED = """
Finance/Crypto: crypto|token|coin|market|finance|econom
Public health & medicine: health|covid|vaccine|medicine|disease|pandemic|hospital
Politics: politic|election|government|policy|war|conflict|ukraine|russia
Crime & public safety: crime|terror|shooting|police|fraud|scam
Gaming/Gambling: gaming|gambling|casino|betting|lottery
Sports: sport|football|soccer|basketball|tennis|nba|nfl
Technology: technology|tech|software|platform|ai |blockchain|internet|science|research|study
Lifestyle & well-being: lifestyle|well-being|culture|entertainment|celebrity|society|community
News/Information: news|headline|breaking|coverage|update
Conversation/Chat/Other: comment|conversation|chat|q&a|ama
Other theme:
"""
CLAIM_RULES_REDUCED = """
No substantive claim: no substantive claim
Verifiable factual statement: verifiable|factual
Rumour / unverified report: rumour|unverified
Misleading context / cherry-picking: misleading|cherry
Promotional hype / exaggerated profit guarantee: promotional|exaggerated profit
Emotional appeal / fear-mongering: fear|emotional
Scarcity/FOMO tactic: scarcity|fomo
Statistics: statistic
Fake content: fake|fabricated
Speculative forecast / prediction: predict|forecast
Announcement: announcement
Opinion / subjective statement: opinion|analysis|review
None / assertion only: assertion only
Other claim type:
"""
CTA_RULES_REDUCED = """
No CTA: no cta
Engage/Ask questions: engage|ask
Attend event / livestream: attend|event|livestream
Join/Subscribe: join|subscribe|follow
Buy / invest / donate: buy|invest|donate
Share / repost / like: share|repost|like
Visit external link / watch video: visit|watch|link|website
Other CTA:
"""

# The codebook, label then pattern, in codebook order; labels without a pattern are reached by name only.
CODEBOOK = {
    "theme": """
Finance/Crypto: crypto|cryptocurrency|token|coin|btc|eth|defi|airdrop|staking|wallet|exchange|price|liquidity|holders|market|trading|nft|web3|blockchain
Public health & medicine: vaccine|covid|health|medicine|medical|disease|doctor|clinic|pharma|virus|public health
Politics: election|politic|government|president|senate|parliament|policy|democrat|republican|ukraine|russia|israel|gaza
Crime & public safety: crime|police|shooting|attack|terror|security alert|missing person|public safety
News/Information:
Technology: ai|artificial intelligence|software|app|platform|tech|technology|robot|innovation|cyber|data|model
Gaming/Gambling: casino|gambl|betting|slots|poker|blackjack
Sports: sport|football|soccer|nba|nfl|match|tournament|goal|league
Lifestyle & well‑being: fitness|diet|well[-\\s]?being|wellness|lifestyle|productivity|mindset
Conversation/Chat/Other: hello|thanks|thank you|gm\\b|good morning|good night|welcome|admin|channel meta|housekeeping
Other (Theme):
""",
    "claim_types": """
No substantive claim: no substantive claim|no claim|no substantive
Announcement: announcement|housekeeping|schedule|available now
Speculative forecast / prediction: forecast|prediction|target|will|expect|projected
Promotional hype / exaggerated profit guarantee: guarantee|profit guarantee|set to explode|no risk|100x|10x|5x|moon
Scarcity/FOMO tactic: fomo|scarcity|last chance|ends today|limited
Misleading context / cherry‑picking: cherry|misleading context
Emotional appeal / fear‑mongering: fear|fear-mongering|emotional appeal|panic|outrage
Rumour / unverified report: rumou?r|unverified|allegedly|leaked|sources say
Opinion / subjective statement: opinion|subjective
Verifiable factual statement: verifiable factual|factual statement|confirmed|reports that
Other (Claim type):
""",
    "ctas": """
Share / repost / like: share|repost|retweet|like
Engage/Ask questions: comment|reply|vote|dm|tell us|what do you think|ask
Visit external link / watch video: watch|click|read more|link below|👇|👉|➡️
Buy / invest / donate: buy|sell|invest|donate|long|short|entry|tp|sl
Join/Subscribe: join|subscribe|follow|register|whitelist
Attend event / livestream: live now|livestream|ama|webinar|event|stream
No CTA:
""",
    "evidence": """
None / assertion only:
Link/URL: link|url|http
Quotes/Testimony: "|\\bsaid\\b|according to|testimony
Statistics: \\b\\d+\\b|%|million|billion|price|profit
Chart / price graph / TA diagram: chart|graph|tradingview|ta\\b
Other (Evidence):
""",
}
# Other spellings of codebook labels, by field.
SYNONYMS = {
    "theme": {
        "lifestyle & well-being": "Lifestyle & well‑being", "lifestyle & well being": "Lifestyle & well‑being", "healthcare": "Public health & medicine", "health": "Public health & medicine",
        "medicine": "Public health & medicine", "public health": "Public health & medicine", "finance": "Finance/Crypto", "economics": "Finance/Crypto",
        "cryptocurrency trading / investment": "Finance/Crypto", "crypto/blockchain": "Finance/Crypto", "cryptocurrency": "Finance/Crypto",
        "blockchain": "Finance/Crypto", "nft creation / minting": "Finance/Crypto", "promotion / advertising": "Finance/Crypto",
    },
    "claim_types": {"rumor / unverified report": "Rumour / unverified report", "rumour/unverified report": "Rumour / unverified report", "speculative forecast/prediction": "Speculative forecast / prediction",
        "emotional appeal / fear-mongering": "Emotional appeal / fear‑mongering", "misleading context / cherry-picking": "Misleading context / cherry‑picking"},
    "ctas": {},
    "evidence": {"none": "None / assertion only"},
}
OTHER = {"theme": "Other (Theme)", "claim_types": "Other (Claim type)", "ctas": "No CTA", "evidence": "Other (Evidence)"}


def rules(text: str) -> list[tuple[str, str]]:
    """(label, pattern) pairs of a rule table; an empty pattern matches nothing."""
    lines = [line for line in text.split("\n") if line]
    return [(name, pattern[1:]) for name, _, pattern in (line.partition(":") for line in lines)]


def bucket(label: Column, table: str, exact: bool = True) -> Column:
    """Bucket of one label: itself if it is one (where exact), else the first whose substring it holds, else the last."""
    pairs = rules(table)
    out = F.when(label.isin([a for a, _ in pairs]) if exact else F.lit(False), label)
    for name, pattern in pairs[:-1]:
        if pattern:
            out = out.when(F.lower(label).rlike(pattern), name)
    return out.otherwise(pairs[-1][0])


def norm_theme(c: Column, fold_dashes: bool = False, table: str = THEME_RULES) -> Column:
    """Theme bucket; null and blank give null."""
    t = utrim(F.translate(c, "‑–—", "---") if fold_dashes else c)
    return F.when(t != "", bucket(t, table))


def norm_labels(c: Column, table: str, drop: str | None = None, exact: bool = True) -> Column:
    """Buckets of the labels of a packed field, each once, in order of first place."""
    labels = tokenize_multi(c)
    if drop:
        labels = F.filter(labels, lambda x: ~F.lower(x).rlike(drop))
    return F.array_distinct(F.transform(labels, lambda x: bucket(x, table, exact)))


def _prefixed(prefix: str):
    return lambda x: F.concat(F.lit(prefix), x)


def style_tokens(theme: Column | None, claims: Column, ctas: Column, evidence: Column) -> Column:
    """field=value tokens of the normalised tags."""
    parts = [] if theme is None else [F.when(theme.isNotNull(), F.array(F.concat(F.lit("theme="), theme))).otherwise(F.array().cast("array<string>"))]
    for name, labels in (("claim", claims), ("cta", ctas), ("evid", evidence)):
        parts.append(F.transform(labels, _prefixed(f"{name}=")))
    return F.concat(*parts)


def norm_text(c: Column) -> Column:
    """Compatibility form, plain dashes, single blanks."""
    return utrim(F.regexp_replace(F.translate(nfkc(c), "‐‑–—", "----"), r"(?U)\s+", " "))


def codebook_label(label: Column, field: str) -> Column:
    """Codebook label of one cleaned label: by name, by synonym, by the first pattern, else the field's other label."""
    pairs = rules(CODEBOOK[field])
    low = F.lower(label)
    out = F.when(label.isNull() | low.isin("", "nan"), F.lit(None))
    for name, _ in pairs:
        out = out.when(low == name.lower(), name)
    for typed, name in SYNONYMS[field].items():
        out = out.when(low == typed, name)
    for name, pattern in pairs:
        if pattern:
            out = out.when(low.rlike(pattern), name)
    return out.otherwise(F.lit(None) if field == "ctas" else F.lit(OTHER[field]))


def codebook_field(clean: Column, field: str) -> Column:
    """Array of the codebook labels of a cleaned, comma-separated field in codebook order."""
    names = [n for n, _ in rules(CODEBOOK[field])]
    other = OTHER[field]
    labels = F.transform(F.filter(F.transform(F.split(F.coalesce(clean, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: codebook_label(x, field))
    known = F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(labels, n))
    known = F.when(F.size(known) > 1, F.array_remove(known, other)).otherwise(known)
    return F.when(F.size(known) == 0, F.array(F.lit(other))).otherwise(known)


def enforce(labels: Column, field: str) -> Column:
    """Constraints on a field's codebook labels in codebook order."""
    if field == "claim_types":
        fact = "Verifiable factual statement"
        clash = F.array_contains(labels, "Rumour / unverified report") | F.array_contains(labels, "Announcement")
        out = F.when(clash, F.array_remove(labels, fact)).otherwise(labels)
        none = "No substantive claim"
        return F.when(F.array_contains(labels, none), F.array(F.lit(none))).otherwise(F.slice(out, 1, 3))
    if field == "evidence":
        return F.when(F.size(labels) > 1, F.array_remove(labels, "None / assertion only")).otherwise(labels)
    return labels
