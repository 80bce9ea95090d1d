"""Links, mentions and mail addresses in free text, links to shops, and objects embedded in pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenewright.functions.text import running_sums

# White space as browsers see it, and what a link, a mention and a mail address look like.
_SPACE = r"\t-\r    -     　﻿"
URL, WWW = rf"https?://[^{_SPACE}]+", rf"(?<!https?://)www\.[^{_SPACE}]+"
MENTION, EMAIL = r"@[a-zA-Z0-9_-]+(?![@\w.-]*\.[a-zA-Z]{2,})", r"[\w.-]+@(?:[\w-]+\.)+[\w-]{2,4}"
# Shops by what their addresses hold, and what one does there; from how many milliseconds on a track
# without such a link leads to its own page.
PLATFORMS = [("bandcamp.com", "Bandcamp", "Buy"), ("hypeddit.com", "Hypeddit", "Free Download"), ("beatport.com", "Beatport", "Buy")]
LONG_MS = 15 * 60 * 1000

#: Two private-use characters: one parts matches from the rest, the other stands in for it where a text has it.
MARK, OTHER = "", ""


def entities(text: Column) -> Column:
    """An array of (start, end, kind, value) in the order of the text: kind is url, mention or email, value the address
    (https:// before one that begins with www), the name without its @, or the mail address.

    One scan from left to right: at each place a link, a www address, a mention and a mail address are tried in this
    order, and the scan goes on behind what was found, so none overlaps another. Null has none."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARK, OTHER), F.lit("|".join(f"(?:{p})" for p in (URL, WWW, MENTION, EMAIL))), F.lit(f"{MARK}$0{MARK}"))
    parts = F.split(marked, MARK)  # every other one is a match
    starts = running_sums(F.transform(parts, lambda p: F.length(p)))
    told = F.zip_with(parts, starts, lambda p, at: F.struct(p.alias("p"), at.alias("at")))

    def one(x: Column) -> Column:
        p = x["p"]
        kind = F.when(F.rlike(p, F.lit("^(?:https?://|www[.])")), "url").when(F.startswith(p, F.lit("@")), "mention").otherwise("email")
        value = F.when(F.startswith(p, F.lit("www.")), F.concat(F.lit("https://"), p)).when(F.startswith(p, F.lit("@")), F.substring(p, F.lit(2), F.length(p))).otherwise(p)
        return F.struct(x["at"].alias("start"), (x["at"] + F.length(p)).alias("end"), kind.alias("kind"), value.alias("value"))

    return F.transform(F.filter(told, lambda x, i: i % 2 == 1), one)


def external_links(purchase: Column, download: Column, description: Column, duration: Column, own: Column, home: str = "Home") -> Column:
    """An array of (url, platform, action): the first address of each platform, in the order purchase, download, then
    those of the description. A track longer than LONG_MS without any leads to its own page, on the platform `home`."""
    urls = F.concat(F.array(purchase, download), F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(f"({URL})"), 1))

    # an address belongs to the first platform that it names
    named = lambda u: F.coalesce(*[F.when(F.contains(F.lower(u), F.lit(m)), p) for m, p, _ in PLATFORMS])
    told = F.filter(F.transform(urls, lambda u, i: F.struct(i.alias("at"), u.alias("url"), named(u).alias("platform"))), lambda x: x["platform"].isNotNull())
    of = lambda platform: F.get(F.filter(told, lambda x: x["platform"] == platform), 0)
    hits = F.array(*[of(p) for _, p, _ in PLATFORMS])
    action = lambda p: F.coalesce(*[F.when(p == name, a) for _, name, a in PLATFORMS])
    found = F.transform(F.array_sort(F.filter(hits, lambda x: x.isNotNull())), lambda x: F.struct(x["url"].alias("url"), x["platform"].alias("platform"), action(x["platform"]).alias("action")))
    page = F.array(F.struct(own.alias("url"), F.lit(home).alias("platform"), F.lit("Listen").alias("action")))
    return F.when((F.size(found) == 0) & F.coalesce(duration > LONG_MS, F.lit(False)), page).otherwise(found)


def embedded(html: Column, name: str) -> Column:
    """The list that a page's first script naming `name` assigns to it, as a VARIANT; null where there is none, or what
    stands there is no JSON."""
    scripts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)
    script = F.get(F.filter(scripts, lambda s: F.contains(s, F.lit(name))), 0)
    quoted = "".join(f"[{c}]" if not c.isalnum() and c != "_" else c for c in name)
    found = F.regexp_extract(script, rf"(?s){quoted}\s*=\s*(\[.*\])", 1)
    return F.try_parse_json(F.when(found != "", found))


def hydrated_user(html: Column, name: str) -> Column:
    """(id, permalink, username, followers_count) of the first item of kind `user` in a page's embedded list; null if the
    list lacks one, or its id is no whole number, or permalink or username no text."""
    items = F.try_variant_get(embedded(html, name), "$", "array<variant>")
    data = F.get(F.filter(items, lambda x: F.coalesce(F.try_variant_get(x, "$.hydratable", "string") == "user", F.lit(False))), 0)
    whole = F.schema_of_variant(F.try_variant_get(data, "$.data.id", "variant")) == "BIGINT"
    text = lambda c: F.schema_of_variant(F.try_variant_get(data, f"$.data.{c}", "variant")) == "STRING"
    get = lambda c, kind: F.try_variant_get(data, f"$.data.{c}", kind).alias(c)
    good = F.coalesce(whole & text("permalink") & text("username"), F.lit(False))
    return F.when(good, F.struct(get("id", "bigint"), get("permalink", "string"), get("username", "string"), get("followers_count", "bigint")))
