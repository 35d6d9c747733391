"""Text rules as column expressions: lexicons, first-match classes, rates, titles, sentences.

The patterns are Java's; `(?i)` and ASCII word boundaries mean the same in RE2, so they can be run
elsewhere too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the text rules.
HAWKISH = r"(?i)\b(raise[sd]?|raising|hike[sd]?|tighten\w*|restrictive|elevated|further increases?|firmer|upside risks?|vigilan\w*|price stability|inflationary|overheating)\b|remains elevated"
DOVISH = r"(?i)\b(cut[s]?|cutting|lower\w*|ease|easing|accommodat\w*|pause[ds]?|downside risks?|slowdown|weaken\w*|softer|patient|supportive)\b"
HAWKISH_WIRE = (
    r"(?i)\bhawkish\b|\bhike[sd]?\b|\bhiking\b|\braise[sd]? rates\b|\btighten\w*|\bbeat[s]?\b|\bstrong(er|est)?\b|\bhigher than (expected|forecast)|"
    r"\btops? (forecast|estimate)|\bupside surprise|\bjumps?\b|\bsurges?\b|\baccelerat\w*|\brebound\w*|\bhotter\b"
)
DOVISH_WIRE = (
    r"(?i)\bdovish\b|\bcut[s]?\b|\bcutting\b|\blower rates\b|\bease?[sd]?\b|\beasing\b|\bmiss(es|ed)?\b|\bweak(er|est)?\b|\blower than (expected|forecast)|"
    r"\bbelow (forecast|estimate)|\bdownside surprise|\bfalls?\b|\bslumps?\b|\bslow(s|ed|ing|down)?\b|\bcooler\b|\bcontract\w*|"
    r"\btoo late\b|rates?,? (are|is) too high|must (be )?(cut|lower\w*)|should (be )?(cut|lower\w*)"
)
NOT_FX = r"(?i)\bbitcoin\b|\bbtc\b|\bethereum\b|\beth\b|\bcrypto\w*|\baltcoin|\bnasdaq\b|\bs&p\b|\bdow\b|\bearnings\b|\bshares?\b|\bstocks?\b|\bnikkei\b|\bdax\b|\bftse\b"
CURRENCIES = (
    ("JPY", r"(?i)\byen\b|\bjpy\b|bank of japan|\bboj\b|\bueda\b|japan(ese)?\b|\bmof\b|usd/?jpy"),
    ("EUR", r"(?i)\beuro\b|\beur\b|\becb\b|lagarde|euro ?zone|euro ?area|germany|german|france|french|italy|eur/?usd|europe\w*|european union|\bEU\b"),
    ("GBP", r"(?i)sterling|\bgbp\b|\bpound\b|bank of england|\bboe\b|bailey|\buk\b|britain|british|gbp/?usd"),
    ("AUD", r"(?i)\baud\b|aussie|australia|\brba\b|bullock|aud/?usd"),
    ("NZD", r"(?i)\bnzd\b|\bkiwi\b|new zealand|\brbnz\b|nzd/?usd"),
    ("CAD", r"(?i)\bcad\b|loonie|canada|canadian|bank of canada|\bboc\b|macklem|usd/?cad"),
    ("CHF", r"(?i)\bchf\b|\bfranc\b|swiss|switzerland|\bsnb\b|usd/?chf"),
    ("CNY", r"(?i)\bcny\b|\bcnh\b|\byuan\b|renminbi|\bpboc\b|china|chinese"),
    ("MXN", r"(?i)\bmxn\b|\bpeso\b|mexico|mexican"),
    ("USD", r"(?i)\bdollar\b|\busd\b|\bfed\b|\bfomc\b|powell|federal reserve|united states|\bus\b|\bu\.s\.|greenback|treasury|\bjerome\b|interest rates?"),
)
CATEGORIES = (
    ("fx_official_or_intervention", r"(?i)interven\w*|rate check|excessive|one-?sided|disorderly|\bfix\b|verbal intervention"),
    ("central_bank_decision", r"(?i)rate decision|policy decision|minutes|statement|holds? rates|leaves? rates|raises? rates|cuts? rates|lower rates?|\bsep\b|projections|interest rates?|federal reserve|\bthe fed\b"),
    ("central_bank_speaker", r"(?i)\bspeech\b|speaks|says|comments|testimony|press conference|powell|lagarde|bailey|ueda|macklem|bullock|\bjerome\b"),
    ("data_release", r"(?i)\bcpi\b|\bppi\b|\bpmi\b|payrolls|\bgdp\b|unemployment|retail sales|trade balance|inflation rate|\bifo\b|\bzew\b|jobless claims|industrial production|consumer confidence"),
    ("politics_or_trade", r"(?i)tariff\w*|trade deal|trade war|election|budget|parliament|congress|president|prime minister|legislation|shutdown"),
    ("geopolitics", r"(?i)\bwar\b|sanction\w*|missile|strike[sd]?\b|invasion|ceasefire|\bopec\b|attack\w*|conflict"),
    ("orderflow_or_positioning", r"(?i)option expir\w*|expiries|\bbarrier\w*|\bcftc\b|positioning|month-?end|\bflows?\b|\bbids?\b at|\boffers?\b at"),
    ("market_commentary_or_technical", r"(?i)support|resistance|technical|outlook|preview|wrap|forecast|analysts?|strategist|\bchart\b|\blevels?\b"),
)
TOPICS = (
    ("inflation", r"(?i)\binflation|\bprices?\b|\bPCE\b|\bCPI\b"),
    ("labor", r"(?i)\blabor|\blabour|\bemployment|\bjobs?\b|\bwages?\b"),
    ("growth", r"(?i)\bgrowth\b|\bGDP\b|\bdemand\b|\brecession\b"),
    ("financial_conditions", r"(?i)financial conditions|\bbanks?\b|\bcredit\b|\bmarkets?\b"),
    ("balance_sheet", r"(?i)balance sheet|\breserves\b|runoff|\bholdings\b|reinvest"),
    ("path_of_rates", r"(?i)\bpath\b|\bpace\b|next meeting|\bcuts?\b|\bhikes?\b|\bdots?\b"),
)
KINDS = (
    ("press_conference_or_interview", r"(?i)press conference|interview|q&a"),
    ("minutes", r"(?i)minutes|summary of opinions|account of"),
    ("speech_or_testimony", r"(?i)speech|remarks|testimony|lecture|address"),
    ("rate_decision", r"(?i)fomc statement|monetary policy statement|guideline for money market|bank rate|policy rate|monetary policy (summary|decision)|issues fomc"),
    ("fx_or_intervention_comment", r"(?i)exchange rate|intervention|foreign exchange"),
    ("data_or_survey", r"(?i)survey|statistics|projections|forecast|results"),
    ("operational_or_regulatory", r"(?i)enforcement|supervis|regulat|appointment|payment system"),
)
CHANNELS = (
    ("projections_or_dots", r"(?i)\bdots?\b|projections?|median projection|dot plot"),
    ("vote_or_dissent", r"(?i)dissent\w*|voted against|voting against"),
    ("balance_sheet", r"(?i)balance sheet|securities holdings|reinvest\w*|runoff|purchases?"),
    ("forward_guidance", r"(?i)forward guidance|anticipates?|in determining the (extent|timing)"),
)
INTERVENTION = (
    (4.0, r"(?i)\b(interven\w+|entered the market|conducted .{0,20}operations? in the foreign exchange)\b"),
    (3.0, r"(?i)decisive action|appropriate action|rate check|all options"),
    (2.0, r"(?i)excessive|one-?sided|disorderly|rapid (and )?speculative"),
    (1.0, r"(?i)exchange rate|currency|foreign exchange|\bfx\b"),
)
BEARISH_TITLE = r"(?i)\b(delist\w*|removal|remove\w*|monitoring tag|suspend\w*|cease\w*|discontinu\w*|terminat\w*)\b"
BULLISH_TITLE = r"(?i)\b(will list|lists?|will add|adds?|will launch|launch\w*|will support|supports?|now available)\b"
DECIDED = r"(?i)decided to\s+([^.]{0,200})"
DID_HIKE = r"(?i)\b(?:raise|raised|raises|increase|increased)\s+the\s+target\s+range|\braise\s+the\s+target\b"
DID_CUT = r"(?i)\b(?:lower|lowered|lowers|reduce|reduced|cut|cuts)\s+the\s+target\s+range"
PERCENT = r"(\d+(?:-\d+/\d+)?(?:\.\d+)?)\s*(?i:percent|per cent|%)"
_RANGE = r"\d+(?:-\d+/\d+)?(?:\.\d+)?(?:\s+to\s+\d+(?:-\d+/\d+)?(?:\.\d+)?)?"
TITLE_RATE = rf"(?i)\b(?:at|to)\s+({_RANGE})\s*(?:percent|per cent|%)"
DECISION = (
    r"(?i)\b(?:maintain|maintained|maintains|keep|kept|keeps|hold|held|holds|raise|raised|raises|increase|increased|increases|lower|lowered|lowers|cut|cuts|reduce|reduced|reduces)\s+"
    r"(?:the\s+)?(?:target range for the federal funds rate|federal funds rate|bank rate|policy rate|uncollateralized overnight call rate|deposit facility rate|cash rate|official cash rate|policy interest rate|overnight rate target|overnight rate)\s+"
    rf"(?:unchanged\s+)?(?:at|to|by\s+[^.]{{0,40}}?\bto)\s+({_RANGE})\s*(?:percent|per cent|%)"
)
TARGET = r"(?i)(?:target range|target rate|federal funds rate|bank rate|policy rate|uncollateralized overnight call rate)[^.]{0,160}?\bto\s+([^.]{0,60}?)(?:percent|per cent|%)"
QUOTE = "USDT USDC FDUSD BUSD TUSD USD1 USDP DAI USDE USDS USD EUR TRY BRL ARS JPY GBP ZAR UAH PLN RON CZK MXN COP NGN KRW IDR VND AUD CAD CHF RUB BIDR BVND USDⓈ".split()
STOP = "UTC AM PM APR APY VIP API P2P NFT ETF KYC FAQ OTC CM UM UID ID TBA TBD GMT NA AI USDS-M COIN-M LP TGE IPO IEO DEX CEX FDV ATH ATL EST PST CET SGT HKT JST KST PDT".split()
ABBREVIATIONS = "mr mrs ms dr jr sr st no vs etc inc corp co approx fig al ca pp vol sen rep gov messrs prof".split()
# Runs of whitespace other than a single space; a stop, with all dots that follow it, before a space and a new sentence.
BLANKS = r"[\s\x01](?:(?<! )[\s\x01]*|[\s\x01]+)"
SENTENCE_END = rf"([.!?](?<!\.\.|(?<![^ ])(?i:{'|'.join(ABBREVIATIONS)})\.)\.*+)(?<!(?<![^ ])(?:[A-Za-z]\.){{1,4}}) (?=[\"“‘(\[]?[A-Z0-9])"
_SYMBOL = "[A-Z0-9\\u4e00-\\u9fff]{2,12}"
TICKERS = (rf"\(({_SYMBOL})\)", rf"(?<![A-Z0-9])({_SYMBOL})/(?:USDT|USDC|USD|BTC|ETH|BNB|FDUSD|USD1|TRY|EUR|BRL|TUSD|USDE)\b", rf"(?<![A-Z0-9/])({_SYMBOL}?)(?:USDT|USDC)\b")
YEARS = r"\b(19|20)\d{2}\b"
MONTHS = r"\b(january|february|march|april|may|june|july|august|september|october|november|december|q[1-4]|h[12])\b"
CHAIR, VICE = r"(?i)\bchair(man|woman)?\b", r"(?i)\bvice\b"
CHROME = r"(?i)^(share|menu|home|print|last update|return to text|for media inquiries|skip to|back to)\b"


def text_of(*parts: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])


def first_match(text: Column, table, otherwise) -> Column:
    """The name of the first pattern of the table that the text has."""
    text, out = F.coalesce(text, F.lit("")), None
    for name, pattern in table:
        hit = F.regexp_like(text, F.lit(pattern))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def word_lean(text: Column) -> Column:
    """Struct (stance, hawks, doves, strength): counts of the two lexicons, and how lopsided they are."""
    h, d = hits(text, HAWKISH), hits(text, DOVISH)
    stance = F.when(h == d, "neutral").when(h > d, "hawkish").otherwise("dovish")
    return F.struct(stance.alias("stance"), h.alias("hawks"), d.alias("doves"), F.when(h == d, 0.0).otherwise(F.abs(h - d) / (h + d)).alias("strength"))


def wire_direction(text: Column) -> Column:
    up, down = hits(text, HAWKISH_WIRE), hits(text, DOVISH_WIRE)
    return F.when(up == down, "none").when(up > down, "stronger").otherwise("weaker")


def currency(text: Column) -> Column:
    return first_match(text, CURRENCIES, "none")


def category(text: Column) -> Column:
    return first_match(text, CATEGORIES, "other")


def title_kind(title: Column, feed_kind: Column | None = None) -> Column:
    kind = first_match(title, KINDS, "other")
    return kind if feed_kind is None else F.when((kind == "other") & (feed_kind == "testimony"), "speech_or_testimony").otherwise(kind)


def channel(text: Column, rate_surprise: Column) -> Column:
    return F.when(rate_surprise, "rate_decision").otherwise(first_match(text, CHANNELS, "nothing_surprising"))


def about_fx(text: Column) -> Column:
    return ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(NOT_FX)) & (currency(text) != "none")


def dominant_topic(text: Column) -> Column:
    """The topic with the most hits, the alphabetically last of equals; 'other' without hits."""
    best = F.greatest(*[F.struct(hits(text, p).alias("n"), F.lit(t).alias("t")) for t, p in TOPICS])
    return F.when(best["n"] > 0, best["t"]).otherwise("other")


def intervention_level(text: Column) -> Column:
    return first_match(text, INTERVENTION, 0.0).cast("double")


def title_side(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return F.when(F.regexp_like(t, F.lit(BEARISH_TITLE)), -1).when(F.regexp_like(t, F.lit(BULLISH_TITLE)), 1).otherwise(0)


def action(text: Column) -> Column:
    """What the decision sentence says was done: hike, cut or hold."""
    t = F.coalesce(text, F.lit(""))
    scope = F.when(F.regexp_like(t, F.lit(DECIDED)), F.regexp_extract(t, DECIDED, 1)).otherwise(t)
    return F.when(F.regexp_like(scope, F.lit(DID_HIKE)), "hike").when(F.regexp_like(scope, F.lit(DID_CUT)), "cut").otherwise("hold")


def versus(later: Column, earlier: Column) -> Column:
    sign = lambda c: F.when(c == "hawkish", 1).when(c == "dovish", -1).otherwise(0)
    gap = sign(later) - sign(earlier)
    return F.when(gap > 0, "more_hawkish").when(gap < 0, "more_dovish").otherwise("consistent")


def title_family(title: Column) -> Column:
    """A title without years, months and numbers, so that editions fall together."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), YEARS, " ")
    t = F.regexp_replace(t, MONTHS, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[\d–—-]+", " "), r"[^a-z ]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of a text: not split after initials and abbreviations, furniture and short ones dropped.

    The ends are marked in one pass: behind a stop, where the last word before it is no initial and no
    abbreviation, so that nothing is split that would have to be joined again.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))
    parts = F.split(F.regexp_replace(flat, SENTENCE_END, "$1\x01"), "\x01")
    return F.filter(parts, lambda s: (F.length(s) >= least) & ~F.regexp_like(F.left(s, F.lit(24)), F.lit(CHROME)))  # furniture opens a sentence


def headline(text: Column, given: Column, limit: int = 120) -> Column:
    """The first `limit` characters cut at a word where one ends past half, with '...'; the given headline, cleaned, for an empty text."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(body, 1, limit)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    worded = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space > limit // 2), F.lit(True))
    short = F.when(worded, F.left(cut, space)).otherwise(cut)
    said = F.regexp_replace(F.trim(F.coalesce(given, F.lit(""))), r'^[^:"“]{1,60}:\s*["“]', "")
    return F.when(body == "", F.trim(F.regexp_replace(said, r'["”]\s*$', ""))).when(F.length(body) <= limit, body).otherwise(F.concat(F.rtrim(short), F.lit("...")))


def rate_value(text: Column) -> Column:
    """A percentage written 4, 4.00, 3-3/4 or 1/4 as a number."""
    t = F.trim(F.coalesce(text, F.lit("")))
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    mixed, bare = r"(\d+)-(\d+)/(\d+)", r"^\s*(\d+)/(\d+)\s*$"
    return (
        F.when(F.regexp_like(t, F.lit(mixed)), F.when(part(mixed, 3) > 0, part(mixed, 1) + part(mixed, 2) / part(mixed, 3)).otherwise(part(mixed, 1)))
        .when(F.regexp_like(t, F.lit(bare)), F.when(part(bare, 2) > 0, part(bare, 1) / part(bare, 2)))
        .otherwise(part(r"(-?\d+(?:\.\d+)?)", 1))
    )


def range_top(text: Column) -> Column:
    """The largest number of a written range: 3-1/2 to 3-3/4 is 3.75."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+-\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"), 1), rate_value))


def announced_rate(title: Column, body: Column) -> Column:
    """The rate of a decision: in the title, else the decision sentence, else a target phrase, else the text's only percentage; of a range the top."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    every = F.concat(t, F.lit("\n"), b)
    found = lambda s, p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    alone = F.regexp_extract_all(every, F.lit(PERCENT), 1)
    return F.coalesce(range_top(found(t, TITLE_RATE)), range_top(found(b, DECISION)), range_top(found(t, DECISION)), range_top(found(every, TARGET)), F.when(F.size(alone) == 1, rate_or_null(F.get(alone, F.lit(0)))))


def rate_or_null(text: Column) -> Column:
    return F.when(text.isNotNull(), rate_value(text))


def level_of(label: Column) -> Column:
    """The level of a histogram row: a number, or the one quarter point inside a bucket, else its midpoint; null for other labels."""
    bucket = r"^\s*(-?\d+(?:\.\d+)?)\s*[-‐-―]\s*(-?\d+(?:\.\d+)?)\s*$"
    plain = F.regexp_extract(label, r"^\s*(-?\d+(?:\.\d+)?)\s*$", 1).try_cast("double")
    a, b = (F.regexp_extract(label, bucket, i).try_cast("double") for i in (1, 2))
    low, high = F.least(a, b), F.greatest(a, b)
    first, last = F.floor(low / 0.25 + 1e-9) + 1, F.ceil(high / 0.25 - 1e-9) - 1
    return F.coalesce(plain, F.when(first == last, first * 0.25), (low + high) / 2)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body names it, also within higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, chunk: int = 256) -> Column:
    """Running sums of an array of whole numbers: those of chunks, and within the chunk."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    start = lambda i: F.floor(i / chunk).cast("int")
    chunks = lambda d: F.transform(F.sequence(F.lit(0), start(F.greatest(F.size(d) - 1, F.lit(0)))), lambda c: total(F.slice(d, c * chunk + 1, F.lit(chunk))))
    before = lambda c: F.transform(c, lambda _, k: total(F.slice(c, F.lit(1), k)))
    sums = lambda d, p: F.transform(d, lambda _, i: F.get(p, start(i)) + total(F.slice(d, start(i) * chunk + 1, i % chunk + 1)))
    return let(numbers, lambda d: let(chunks(d), lambda c: let(before(c), lambda p: sums(d, p))))


def tickers(title: Column, body: Column | None = None, limit: int = 24) -> Column:
    """Unique ticker symbols in order of appearance, title before body: in brackets, before a quote currency's slash, or glued to one."""
    def found(text: Column) -> Column:
        # splitting at matches gives the text between them, whose lengths give the positions
        rows = []
        for p in TICKERS:
            names, whole, between = F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 0), F.split(text, p, -1)
            steps = F.zip_with(between, F.concat(F.array(F.lit("")), whole), lambda x, y: F.length(x) + F.length(y))
            bare = F.transform(names, lambda n: F.regexp_replace(n, "^(?:1000000|1000|1M)(?=[A-Z])", ""))
            rows.append(F.zip_with(F.slice(running(steps), F.lit(1), F.size(names)), bare, lambda at, n: F.struct(at.alias("at"), n.alias("name"))))
        return F.transform(F.sort_array(F.concat(*rows)), lambda x: x["name"])

    every = found(F.coalesce(title, F.lit("")))
    if body is not None:
        every = F.concat(every, found(F.coalesce(body, F.lit(""))))
    fine = F.filter(every, lambda n: ~n.isin(*QUOTE, *STOP) & ~F.regexp_like(n, F.lit("^[0-9:.-]+$")))
    return F.slice(F.array_distinct(fine), 1, limit)


def section(text: Column, heading: str, tail: Column | None = None, limit: int = 4000) -> Column:
    """From the heading on, then the tail of another section, at most `limit` characters; the last `limit` without the heading."""
    at = F.regexp_instr(F.coalesce(text, F.lit("")), F.lit(heading))
    got = F.when(at > 0, F.substring(text, at, F.lit(limit))).otherwise(F.right(F.coalesce(text, F.lit("")), F.lit(limit)))
    return got if tail is None else F.concat_ws("\n", got, tail)


def is_chair(name: Column) -> Column:
    return F.regexp_like(name, F.lit(CHAIR)) & ~F.regexp_like(name, F.lit(VICE))


def slug(text: Column, limit: int = 60) -> Column:
    return F.right(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(limit))


def keyword_hit(text: Column, words: list[str]) -> Column:
    """Whether a word of the list is in the text, whole and in either case."""
    import re

    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(" + "|".join(re.escape(w) for w in words) + r")\b"))
