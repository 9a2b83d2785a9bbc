"""Column expressions that normalise currency, brand, size, colour, gender, region and codes."""

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Currency by a part of the host, by its end, and region by its end.
STORE_CURRENCY = {"dope-factory.com": "KRW", "laferramenta.org": "EUR", "oneblockdown.it": "EUR", "starcowparis.com": "EUR", "slamcity.com": "GBP", "noteshop.co.uk": "GBP"}
DOMAIN_CURRENCY = {
    ".kr": "KRW", ".jp": "JPY", ".cn": "CNY", ".eu": "EUR", ".de": "EUR", ".fr": "EUR", ".it": "EUR", ".es": "EUR", ".nl": "EUR", ".be": "EUR", ".at": "EUR", ".uk": "GBP", ".co.uk": "GBP",
    ".ca": "CAD", ".au": "AUD", ".com.au": "AUD", ".ch": "CHF", ".se": "SEK", ".no": "NOK", ".dk": "DKK", ".pl": "PLN", ".cz": "CZK", ".hu": "HUF",
}
FALLBACK_RATES = {"EUR": "0.92", "GBP": "0.79", "JPY": "149.5", "KRW": "1320.0", "CAD": "1.36", "AUD": "1.53", "CHF": "0.88", "SEK": "10.5", "NOK": "10.8", "DKK": "6.87", "PLN": "4.02", "CZK": "23.1", "HUF": "355.0", "CNY": "7.24"}
SUPPORTED = ("USD", *FALLBACK_RATES)
ADAPTER_REGION = {".uk": "GB", ".de": "DE", ".fr": "FR", ".it": "IT", ".jp": "JP", ".cn": "CN"}
TLD_REGION = {
    ".uk": "GB", ".co.uk": "GB", ".de": "DE", ".fr": "FR", ".it": "IT", ".es": "ES", ".nl": "NL", ".be": "BE", ".at": "AT", ".ch": "CH", ".se": "SE", ".no": "NO", ".dk": "DK", ".fi": "FI", ".pt": "PT", ".ie": "IE",
    ".pl": "PL", ".cz": "CZ", ".eu": "EU", ".jp": "JP", ".kr": "KR", ".cn": "CN", ".hk": "HK", ".sg": "SG", ".tw": "TW", ".ca": "CA", ".us": "US", ".mx": "MX", ".au": "AU", ".com.au": "AU", ".nz": "NZ", ".ru": "RU",
    ".ua": "UA", ".br": "BR", ".ar": "AR", ".cl": "CL",
}
# Colour words by colour, and strings that name no colour.
COLOURS = {
    "BLACK": "black nero negro noir", "WHITE": "white bianco blanco blanc", "GREY": "grey gray gris", "BLUE": "blue navy azul blu", "RED": "red crimson scarlet rojo rosso", "GREEN": "green olive verde",
    "BROWN": "brown chocolate marron marrone", "BEIGE": "beige tan cream", "PURPLE": "purple violet viola", "ORANGE": "orange arancione naranja", "YELLOW": "yellow gold giallo amarillo", "PINK": "pink rose rosa", "MULTI": "multi multicolor",
}
NOT_COLOURS = ("men", "women", "unisex", "kids", "one size", "new", "xl", "l", "m", "s", "xs", "xxl")


def url_host(url):
    """Host of a url, lower-cased, without port and credentials."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), r":\d*$", ""))


def _chain(cases, default=None):
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(default).cast("string"))


def detect_currency(url):
    """By parts of known hosts, then by the host's end in declared order; null if neither tells."""
    return host_currency(url_host(url))


def host_currency(host):
    return _chain([(host.contains(k), v) for k, v in STORE_CURRENCY.items()] + [(host.endswith(k), v) for k, v in DOMAIN_CURRENCY.items()])


def detect_region(host):
    return _chain([(F.lower(host).endswith(k), v) for k, v in ADAPTER_REGION.items()])


def detect_region_full(host):
    """The longest known end of the host; US if none fits."""
    h = F.lower(F.trim(host))
    return _chain([(h.endswith(k), v) for k, v in sorted(TLD_REGION.items(), key=lambda x: -len(x[0]))], "US")


def normalize_prices(df, rates, price="price", url="url", api_currency="api_currency", default_currency=None):
    """df with currency, rate, usd_price and reject_reason.

    A supported stated currency wins over the detected one. rates has currency
    and rate, 1 USD = rate; it is a small table of currencies, and sent to the
    rows, as these may all be of one currency.
    """
    stated = F.upper(F.trim(F.col(api_currency)))
    supported = F.coalesce(stated.isin(*SUPPORTED), F.lit(False))
    # A column of its own, so that the host is looked for once a row.
    df = df.withColumn("_host", F.when(~supported, url_host(F.col(url))))
    found = F.coalesce(F.when(supported, stated), host_currency(F.col("_host")), F.lit(default_currency).cast("string"))
    df = df.withColumn("currency", found).drop("_host")
    known = F.broadcast(rates.select(F.col("currency").alias("_currency"), F.col("rate").cast("decimal(12,6)").alias("_rate")))
    joined = df.join(known, F.col("currency") == F.col("_currency"), "left")
    rate = F.when(F.col("currency") == "USD", F.lit(1).cast("decimal(12,6)")).otherwise(F.col("_rate"))
    reason = F.when(F.col("currency").isNull(), "unknown_currency").when(~F.col("currency").isin(*SUPPORTED), "unsupported_currency").when(F.col("_r").isNull(), "missing_rate")
    joined = joined.withColumn("_r", rate)
    usd = F.col(price).cast("decimal(12,2)") / F.col("_r")
    return joined.withColumn("reject_reason", reason).withColumn("usd_price", F.when(F.col("reject_reason").isNull(), usd).cast("decimal(10,2)")).withColumn("rate", F.col("_r")).withColumn("currency", F.coalesce("currency", F.lit("UNKNOWN"))).drop("_r", "_rate", "_currency")


def rebase_rates_to_usd(quotes):
    """Quotes per euro as quotes per dollar, by the dollar's own row, which goes."""
    usd = quotes.where("currency = 'USD'").select(F.col("rate").alias("usd_rate"), F.lit(1).alias("one"))
    return quotes.withColumn("one", F.lit(1)).join(F.broadcast(usd), "one").where("currency <> 'USD'").select("currency", (F.col("rate") / F.col("usd_rate")).cast("decimal(12,6)").alias("rate"))


@F.pandas_udf(StringType())
def strip_accents(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return names.str.normalize("NFKD").str.replace(r"[̀-ͯ҃-҉֑-ֽ⃐-⃿]", "", regex=True)


def extract_brand(vendor, title):
    """Vendor, else the title's first word, else Unknown."""
    first = F.regexp_extract(F.trim(title), r"^(\S+)", 1)
    return F.coalesce(F.nullif(vendor, F.lit("")), F.nullif(first, F.lit("")), F.lit("Unknown"))


def normalize_size(size):
    """A number with a marker for kids, women or men; null for what is no size."""
    s = F.trim(size)
    upper = F.upper(s)
    marker = F.when(upper.rlike("GS|PS|TD|MO"), "K").when(upper.endswith("B") | upper.rlike(r"(?U)\bW\b"), "W").when(upper.endswith("M") | upper.rlike(r"(?U)\bM\b"), "M").otherwise("")
    number = F.regexp_replace(F.regexp_extract(s, r"([0-9]+(?:[.,][0-9]+)?)", 1), ",", ".")
    plain = F.when(number.contains("."), number.cast("double").cast("string")).otherwise(F.regexp_replace(number, "^0+(?=[0-9])", ""))
    trash = s.isNull() | s.isin("", "*", "-", "--") | s.startswith("$") | (number == "")
    return F.when(~trash, F.concat(F.when(number != "", plain), marker))


def normalize_color(color):
    """One colour, MULTI for several, null for none."""
    s = F.trim(color)
    lower = F.lower(s)
    found = F.array_compact(F.array(*[F.when(lower.rlike(r"(?U)\b(?:" + "|".join(words.split()) + r")\b"), F.lit(name)) for name, words in COLOURS.items()]))
    no = s.isNull() | s.rlike(r"^[0-9]+(\.[0-9]+)?\s*[MW]?$") | lower.isin(*NOT_COLOURS)
    return F.when(no, None).when(F.size(found) == 1, found[0]).when(F.size(found) > 1, F.lit("MULTI"))


# Patterns of the classes, in the order of their trial.
KIDS = r"\b(GS|PS|TD|Grade[\s-]?School|Preschool|Toddler|Infant|Kids?|Pre[\s-]?School)\b|\b(Little|Big)[\s-]?Kids\b|[\s(](GS|PS|TD)[\s)]"
WOMEN = r"\b(WMNS|WMN|Women's|Womens|Women|Wmn)\b|[\s(]W[\s)]"
MEN = r"\b(Men's|Mens)\b|[\s(]Men[\s)]|\bMen(?=\s+['’]?s\b)"
UNISEX = r"\b(Unisex)\b"


def normalize_gender_age(name):
    """KIDS, WOMEN, MEN, UNISEX or UNKNOWN; a card grade is no sign of kids."""
    has = lambda pattern: F.coalesce(name.rlike("(?iU)" + pattern), F.lit(False))
    return F.when(has(r"\bmen\s+in\s+black\b"), "UNKNOWN").when(has(KIDS) & ~has(r"\bPSA\b"), "KIDS").when(has(WOMEN), "WOMEN").when(has(MEN), "MEN").when(has(UNISEX), "UNISEX").otherwise("UNKNOWN")


def gtin_type(code):
    n = F.length(code)
    return F.when(n == 8, "EAN-8").when(n == 12, "UPC-A").when(n == 13, "EAN-13").when(n == 14, "GTIN-14")


def valid_gtin(code):
    """Digits of a known length whose check digit fits, weights 3 and 1 from the right."""
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.substr(code, i, F.lit(1)).cast("int") * F.when((F.length(code) - i) % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    shape = code.rlike("^[0-9]+$") & F.length(code).isin(8, 12, 13, 14)
    return F.coalesce(F.when(shape, total % 10 == 0), F.lit(False))


def store_name(url):
    """Host without www. and .com, every run of letters capitalised."""
    host = F.replace(F.replace(url_host(url), F.lit("www."), F.lit("")), F.lit(".com"), F.lit(""))
    runs = F.regexp_extract_all(host, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))), "")


def product_url(base, handle):
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/products/"), handle)


def alert_fingerprint(sku, store, price):
    return F.substring(F.sha2(F.concat_ws("|", sku, store, price), 256), 1, 16)


def freshness_decay(updated_at, as_of):
    """exp(-days / 10); 30 days where unknown."""
    days = F.coalesce((F.unix_micros(as_of) - F.unix_micros(updated_at)) / F.lit(86_400_000_000), F.lit(30.0))
    return F.exp(-0.1 * F.greatest(F.lit(0.0), days))


def platform(html):
    """Shop platform by markers in a page."""
    h = F.lower(html)
    return F.when(h.contains("shopify.com"), "shopify").when(h.contains("wp-content/plugins/woocommerce"), "woocommerce").when(h.contains("mage/") | h.contains("magento") | h.contains("/static/version"), "magento").otherwise("custom")
