"""Name cleaning and rule-based classification as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.scalar import col

# Issuer code by name prefix, first match wins.
ISSUER_PREFIXES = (
    ("VANGUARD", "vanguard"), ("ISHARES", "blackrock"), ("BLACKROCK", "blackrock"), ("STATE STREET", "state_street"),
    ("SPDR", "state_street"), ("SSGA", "state_street"), ("INVESCO", "invesco"), ("POWERSHARES", "invesco"),
    ("INV ", "invesco"), ("SCHWAB", "schwab"))
ISSUER_PATTERNS = ((r"JPMORGAN|J\.P\. MORGAN", "jpm"),)
# Trust wrappers stripped from the front of a name.
WRAPPER_PREFIXES = (
    r"GS ETF TRUST\s*-\s*", r"GS ETF TRUST II\s*-\s*", r"ISHARES TRUST\s*-\s*",
    r"ISHARES\s+(?:INC\.?|BOND INDEX FUNDS|U\.S\. ETF TRUST)\s*-\s*",
    r"VANGUARD (?:BOND INDEX FUNDS|CHARLOTTE FUNDS|ADMIRAL FUNDS|INDEX FUNDS|SPECIALIZED PORTFOLIOS|MALVERN FUNDS|FENWAY FUNDS|WELLINGTON FUND|WORLD FUNDS|QUANTITATIVE EQUITY GROUP|CONVERTIBLE SECURITIES FUND|EQUITY INDEX GROUP|GROUP OF INVESTMENT COMPANIES)\s*-\s*",
    r"SPDR (?:INDEX SHARES FUNDS|S&P (?:500 )?ETF TRUST)\s*-\s*", r"INVESCO (?:EXCH-TRADED FD TR(?:UST)?|EX\s*-?TR\s+FD\s+TR)\s*(?:II\s*)?\s*-\s*",
    r"INVESCO EXCHANGE-TRADED FUND TRUST\s*(?:II\s*)?\s*-\s*", r"SCHWAB STRATEGIC TRUST\s*-\s*", r"STATE STREET\s+(?:SPDR\s+)?",
    r"FIRST TRUST EXCHANGE-TRADED FUND\s*(?:II|III|IV|V|VI|VII|VIII)?\s*-\s*", r"WISDOMTREE TRUST\s*-\s*", r"VANECK (?:VECTORS )?ETF TRUST\s*-\s*",
    r"PROSHARES TRUST\s*(?:II\s*)?\s*-\s*", r"DIREXION (?:SHARES )?ETF TRUST\s*(?:II\s*)?\s*-\s*", r"GLOBAL X FUNDS\s*-\s*", r"PACER FUNDS TRUST\s*-\s*",
    r"ARK ETF TRUST\s*-\s*", r"INNOVATOR ETFS? TRUST\s*(?:II\s*)?\s*-\s*")
# Replacements anywhere in a name, in this order, before the wrapper is stripped.
BODY_REPLACEMENTS = ((r"\bGOLDMAN SACHS ETF TR(?:UST)?\s*-?\s*", "GS "), (r"\bGOLDMAN SA?CHS\b", "GS"), (r"\bGOLDMAN\b", "GS"), (r"\bGS ETF TRUST\s*-\s*", ""))
# Words kept in capitals after title-casing.
ACRONYMS = ("US", "ETF", "MSCI", "EM", "REIT", "JPY", "USD", "ADR", "IPO", "AI", "ESG", "EAFE", "GDP", "CPI", "TIP",
            "BIL", "VOO", "QQQM", "IJR", "XSD", "GICI")
PLURAL_ACRONYMS = (("Etfs", "ETFs"), ("Reits", "REITs"))


def classify(name, prefixes=ISSUER_PREFIXES, patterns=ISSUER_PATTERNS, default: str = "other") -> Column:
    """First matching rule: regular expressions, then prefixes."""
    n, out = F.upper(col(name)), None
    for rule, code in [*[(n.rlike(p), c) for p, c in patterns], *[(F.startswith(n, F.lit(p)), c) for p, c in prefixes]]:
        out = F.when(rule, code) if out is None else out.when(rule, code)
    return out.otherwise(default)


def classify_with_overrides(df: DataFrame, key: str, name: str, overrides: DataFrame, out: str = "issuer", **rules) -> DataFrame:
    """Override table first, then the rules; the engine chooses the join by the table's size."""
    o = overrides.select(F.col("key").alias("_k"), F.col("code").alias("_code"))
    return df.join(o, F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_code", classify(name, **rules))).drop("_k", "_code")


def clean_name(raw, prefixes=WRAPPER_PREFIXES, acronyms=ACRONYMS, plurals=PLURAL_ACRONYMS, token: str = " ETF ", limit: int = 80, body=BODY_REPLACEMENTS) -> Column:
    """Replace in the body, strip one wrapper, cut a doubled name at its first token, title-case, restore acronyms."""
    x = F.trim(col(raw))
    for pattern, text in body:
        x = F.regexp_replace(x, "(?i)" + pattern, text)
    x = F.regexp_replace(x, r"(?i)^(?:" + "|".join(prefixes) + ")", "")
    first = F.position(F.lit(token), F.upper(x), F.lit(11))
    second = F.when(first > 0, F.position(F.lit(token), F.upper(x), first + 5))
    x = F.when((F.length(x) > limit) & (first > 0) & (second > 0), F.trim(F.substring(x, F.lit(1), first + F.lit(len(token) - 2)))).otherwise(x)
    # a letter after any non-letter starts a word
    x = F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), F.initcap), "")
    for a in acronyms:
        x = F.regexp_replace(x, rf"\b{a.capitalize()}\b", a)
    for a, b in plurals:
        x = F.regexp_replace(x, rf"\b{a}\b", b)
    return F.trim(F.regexp_replace(x, r"\bU\.S\.", "U.S."))


def band(tagged, asset_class) -> Column:
    """Priority bands: tag, then asset class, else untagged."""
    a = F.trim(col(asset_class))
    return (F.when(col(tagged), "Cash-like").when(F.length(a) > 0, F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substring(a, 2, 1000))))
             .otherwise("Untagged"))


def trial_label(**params) -> Column:
    """Trial id text from parameter columns, decimal points written as p."""
    parts = [F.concat(F.lit(k), F.regexp_replace(col(c).cast("string"), r"\.", "p")) for k, c in params.items()]
    return F.concat_ws("_", *parts)
