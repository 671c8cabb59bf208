"""Hosts and source tiers of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts (with their subdomains) of each tier, and suffixes that stand for a government.
PRIMARY = [
    "sec.gov", "congress.gov", "senate.gov", "house.gov", "supremecourt.gov", "uscourts.gov", "courtlistener.com", "federalregister.gov", "gao.gov",
    "bls.gov", "census.gov", "cdc.gov", "nih.gov", "europa.eu", "un.org", "who.int", "imf.org", "worldbank.org", "oecd.org", "iaea.org",
]
GOVERNMENT = ["gov", "mil", "gc.ca", "gov.uk"]
SECONDARY = [
    "reuters.com", "apnews.com", "nytimes.com", "washingtonpost.com", "wsj.com", "bloomberg.com", "ft.com", "propublica.org", "npr.org", "pbs.org", "bbc.com", "bbc.co.uk",
    "cnn.com", "politico.com", "axios.com", "theguardian.com", "brookings.edu", "pewresearch.org", "rand.org", "urban.org", "cbpp.org", "kff.org", "nature.com", "science.org",
    "nejm.org", "thelancet.com", "jamanetwork.com", "bostonglobe.com", "latimes.com", "chicagotribune.com",
]
UNACCEPTABLE = ["wikipedia.org", "wiktionary.org", "fandom.com", "medium.com", "substack.com", "prnewswire.com", "businesswire.com", "globenewswire.com", "quora.com"]
UNACCEPTABLE_ALONE = ["news.google.com", "news.yahoo.com", "answers.com", "ehow.com"]

Rules = list[tuple[str, str, bool]]
#: (host, tier, with subdomains), first match wins.
RULES: Rules = (
    [(h, "primary", True) for h in [*PRIMARY, *GOVERNMENT]]
    + [(h, "authoritative_secondary", True) for h in SECONDARY]
    + [(h, "unacceptable", True) for h in UNACCEPTABLE]
    + [(h, "unacceptable", False) for h in UNACCEPTABLE_ALONE]
    + [("edu", "authoritative_secondary", True)]
)


def host(url: Column) -> Column:
    """Lower-case host without port and user, or an empty string."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def tier(host_: Column, rules: Rules = RULES) -> Column:
    """The tier of a host. A suffix such as gov covers hosts of any depth."""
    out = F.lit("unknown")
    for name, label, below in reversed(rules):
        test = host_ == name
        out = F.when(test | host_.endswith("." + name) if below else test, F.lit(label)).otherwise(out)
    return out
