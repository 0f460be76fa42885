"""Canonical URLs as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track readers, besides those that start with utm_.
TRACKING_KEYS = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "vero_conv", "vero_id", "mkt_tok", "oly_anon_id", "oly_enc_id", "ref_src", "ref_url", "spm", "yclid")
_URL = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(url: Column) -> Column:
    """Lower-case host, no credentials, default port, fragment or tracking keys; sorted query; single slashes.

    What is not an http(s) URL with a host comes back trimmed; null is empty.
    """
    text = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(text, _URL, i)
    scheme = F.lower(part(1))
    host = F.lower(F.regexp_replace(F.regexp_replace(part(2), "^.*@", ""), ":$", ""))
    default = F.when(scheme == "http", host.rlike(":80$")).otherwise(host.rlike(":443$"))
    host = F.when(default, F.regexp_replace(host, ":[0-9]+$", "")).otherwise(host)
    path = F.regexp_replace(F.when(part(3) == "", F.lit("/")).otherwise(part(3)), "/{2,}", "/")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)

    def pair(x: Column) -> Column:
        key = F.substring_index(x, "=", 1)
        return F.struct(decoded(key).alias("k"), decoded(F.regexp_replace(x, "^[^=]*=?", "")).alias("v"))

    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda x: x != ""), pair)
    kept = F.filter(pairs, lambda p: ~(F.startswith(F.lower(p["k"]), F.lit("utm_")) | F.lower(p["k"]).isin(*TRACKING_KEYS)))
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    query = F.array_join(F.transform(F.sort_array(kept), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when((scheme != "") & (host != "") & ~F.startswith(host, F.lit(":")), whole).otherwise(text)
