"""Text, filing and calendar functions as column expressions (JVM side, no Python rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------
TITLE_STOP = (
    "the a an and or but of to in on for with at by from as is are was were be been it its that this these those he she they his her "
    "their you your we our us i not no after over into up out new says say said will has have had who what how why amid more"
).split()
VECTOR_STOP = (
    "the a an and or of to in on for with at by from as is are was were be it its that this his her their they we you will has have had "
    "says said after over into out"
).split()
TRACKING_NAME = r"(?i)^(utm_|fbclid$|gclid$|mc_cid$|mc_eid$|ito$|ns_|CMP$|cmpid$|ICID$|at_)"
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "'"), ("&lsquo;", "'"),
    ("&ldquo;", '"'), ("&rdquo;", '"'), ("&mdash;", " - "), ("&ndash;", " - "),
)
OTHER_SECTIONS = (
    "sport football cricket rugby tennis golf boxing f1 formula1 racing fantasy-sports tvshowbiz showbiz celebrity celebs entertainment tv "
    "film movies music arts culture books theatre gaming games lifestyle life-style lifeandstyle life food drink recipes fashion beauty "
    "travel property homes garden motoring cars money shopping deals offers vouchers competitions puzzles crossword sudoku horoscopes "
    "weather dating relationships parenting health-and-fitness"
).split()
OTHER_NESTED = "sport football cricket rugby showbiz tvshowbiz celebrity puzzles crossword horoscopes".split()
SPORT_WORDS = (
    r"premier league|champions league|europa league|fa cup|carabao|man utd|man city|manchester united|manchester city|arsenal|chelsea|"
    r"liverpool|tottenham|spurs|everton|newcastle united|aston villa|west ham|celtic|rangers|old firm|transfer (?:news|window|deadline)|"
    r"wonderkid|striker|midfielder|goalkeeper|kick-?off|full-?time|half-?time|penalty shoot|var |test match|ashes|six nations|grand slam|"
    r"wimbledon|open championship|formula ?1|f1|grand prix|ufc|heavyweight|title fight|solheim|ryder cup|world cup|euro 20\d\d|olympic"
)
SHOW_WORDS = (
    r"strictly come dancing|love island|big brother|celebrity|i'm a celeb|gogglebox|bake off|x factor|emmerdale|coronation street|eastenders|"
    r"hollyoaks|netflix series|reality star|soap star|red carpet|oscars|baftas|brit awards|world tour|new album|girlfriend|boyfriend|"
    r"split from|dating|romance|baby joy|shows off|stuns in|flaunts|opens up about"
)
LIFE_WORDS = (
    r"recipe|horoscope|your stars|best buys?|shopping|deal of the|how to (?:clean|cook|save|get)|money saving|travel deal|skincare|beauty|"
    r"wordle|quiz|puzzle|crossword"
)
DESKS = (
    ("comment", r"/(comment|opinion|columnists?|voices)/"),
    ("leader", r"/(leader|editorial)s?/"),
    ("analysis", r"/(analysis|explainer|long-read)/"),
    ("feature", r"/(feature|magazine|lifestyle)s?/"),
)
LOADED_WORDS = (
    r"fury|furious|slam(?:med|s)?|blast(?:ed|s)?|rage|outrage|chaos|shambles|crackdown|climbdown|cave[sd]?|humiliat\w*|triumph|disaster|"
    r"scandal|blow to|shock(?:ing)?|damning|brutal|savage[ds]?|blasted|meltdown|desperate|absurd|farce|betrayal|woke|shameful"
)
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.35}
FNV_OFFSET, FNV_PRIME, FNV_RANGE = 2_166_136_261, 16_777_619, 4_294_967_296
EPOCH_DAY = "2020-01-01"
# --------------------------------------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """A stable identity: https, lower host without ``www.``, odd ports kept, tracking parameters and
    fragment dropped, trailing slashes cut (``/`` stays). Null or empty gives ''. An address without a
    scheme and host is kept as it is (trimmed). Parameters keep their own percent encoding."""
    text = F.trim(F.coalesce(url, F.lit("")))
    rest = F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(.*)$", 1)
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":\d*$", "")), r"^www\.", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    site = F.when(port.isin("", "80", "443"), host).otherwise(F.concat(host, F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.substring_index(kv, "=", 1).rlike(TRACKING_NAME)), "&")
    full = F.concat(F.lit("https://"), site, F.when(path == "", F.lit("/")).otherwise(path), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.when(authority == "", text).otherwise(full)


def strip_html(text: Column) -> Column:
    """Without scripts, styles, tags and a dozen entities, in that order; white space squeezed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, plain in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^ | $", "")


def trim_standfirst(text: Column, limit: int = 400) -> Column:
    """Longer than ``limit``: cut there, back to the last space, with an ellipsis."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))).otherwise(text)


def _words(text: Column, stop: list[str], quotes: bool) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    if quotes:
        low = F.replace(low, F.lit("’"), F.lit("'"))
    return F.filter(F.regexp_extract_all(low, F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def title_tokens(title: Column) -> Column:
    return _words(title, TITLE_STOP, quotes=True)


def title_signature(title: Column) -> Column:
    """16 hex digits of the distinct title tokens; titles without a token share one signature."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(title_tokens(title))), " ").cast("binary")), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def vector_tokens(text: Column) -> Column:
    """Words and pairs of neighbouring words, ``a_b``."""
    w = _words(text, VECTOR_STOP, quotes=False)
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat(x, F.lit("_"), y)))
    return F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over code points, 32 bit."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(FNV_OFFSET).cast("long"), lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME % FNV_RANGE)


def section(url: Column) -> Column:
    """The path of an address, without slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://[^/]+/([^?#]*)", 1), r"^/+|/+$", "")


def news_by_url(url: Column) -> Column:
    """False where the outlet itself filed the page under something other than news; no path is news."""
    path = section(url)
    first = path.rlike("(?i)^(" + "|".join(OTHER_SECTIONS) + ")(/|$)")
    deeper = F.concat(F.lit("/"), path).rlike("(?i)/(" + "|".join(OTHER_NESTED) + ")(/|$)")
    return (path == "") | ~(first | deeper)


def news_by_text(title: Column, standfirst: Column) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(standfirst, F.lit("")))
    return ~(text.rlike(rf"(?i)\b({SPORT_WORDS})\b") | text.rlike(rf"(?i)\b({SHOW_WORDS})\b") | text.rlike(rf"(?i)\b({LIFE_WORDS})\b"))


def is_news(url: Column, title: Column, standfirst: Column) -> Column:
    """By the address where it has a section, by the words where it does not."""
    u = F.coalesce(url, F.lit(""))
    readable = (section(u) != "") & ~u.contains("news.google.com")
    return F.when(readable, news_by_url(u)).otherwise(news_by_text(title, standfirst))


def desk(url: Column) -> Column:
    out = None
    for name, pattern in DESKS:
        hit = F.coalesce(url, F.lit("")).rlike("(?i)" + pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("news"))  # type: ignore[union-attr]


def clean_name(suggested: Column, fallback: Column) -> Column:
    """A suggested label if it has 2-6 words, at most 42 characters and no loaded word or question."""
    n = F.regexp_replace(F.trim(F.coalesce(suggested, F.lit(""))), r'^"+|"+$', "")
    n = F.regexp_replace(F.trim(n), r"\s+", " ")
    words = F.size(F.split(n, " "))
    good = (n != "") & words.between(2, 6) & (F.length(n) <= 42) & ~n.contains("?") & ~n.rlike(rf"(?i)\b({LOADED_WORDS})\b")
    return F.when(good, F.concat(F.upper(F.substring(n, 1, 1)), n.substr(F.lit(2), F.length(n)))).otherwise(fallback)


def parse_date(text: Column) -> Column:
    """RFC 822 or ISO 8601 to a timestamp; without a zone it is UTC; unreadable is null."""
    t = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3,9},\s*", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    rfc = F.try_to_timestamp(F.regexp_replace(bare, r"^(\d) ", "0$1 "), F.lit("dd MMM yyyy HH:mm:ss xx"))
    iso = F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(t)).otherwise(F.try_to_timestamp(F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z"))))
    return F.coalesce(rfc, F.when(t.rlike(r"^\d{4}-\d\d-\d\d"), iso))


def confidence_weight(confidence: Column) -> Column:
    out = None
    for name, w in CONFIDENCE.items():
        out = F.when(confidence == name, F.lit(w)) if out is None else out.when(confidence == name, F.lit(w))
    return out.otherwise(F.lit(0.7))  # type: ignore[union-attr]


def prominence(position: Column) -> Column:
    return F.when(position < 5, 3).when(position < 15, 2).otherwise(1)


def local_day(at: Column, zone: str = "Europe/London") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def day_index(at: Column) -> Column:
    return F.datediff(F.to_date(at), F.lit(EPOCH_DAY).cast("date"))


def tolerant_json(text: Column, schema: str) -> Column:
    """The first JSON object in a reply that may stand in a code fence or among prose."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def tolerant_json_list(text: Column, schema: str) -> Column:
    """The JSON list in such a reply, item by item; a single object is a list of one, no JSON is null."""
    listed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), f"array<struct<{schema.replace(' ', ':')}>>")
    one = tolerant_json(text, schema)
    begins_with_list = F.regexp_extract(text, r"(?s)^[^\[{]*([\[{])", 1) == "["
    return F.when(begins_with_list & listed.isNotNull(), listed).otherwise(F.when(one.isNotNull() & text.contains("{"), F.array(one)))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 where either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, p: acc + p)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
