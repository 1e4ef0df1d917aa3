"""URLs, taken apart by expressions that return null for what is no URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gh_src", "gh_jid", "source", "src", "ref", "referrer",
    "trk", "trkcampaign", "lever-source", "lever_source", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid",
)
#: Beginnings of the names of such parameters, for the pages that are verified.
TRACKING_BEGINNINGS = ("utm_", "gh_src", "gh_jid", "source", "src", "trk", "tracking", "ref", "referrer", "fbclid", "gclid", "mc_cid", "mc_eid")
#: Hosts whose first path segment is the tenant, and domains whose subdomain is.
PATH_TENANTS = {
    "greenhouse": ("boards.greenhouse.io", "job-boards.greenhouse.io", "boards.eu.greenhouse.io", "job-boards.eu.greenhouse.io"),
    "lever": ("jobs.lever.co", "jobs.eu.lever.co"),
    "ashby": ("jobs.ashbyhq.com",),
    "workable": ("apply.workable.com",),
    "smartrecruiters": ("careers.smartrecruiters.com", "jobs.smartrecruiters.com"),
    "gem": ("jobs.gem.com",),
    "rippling": ("ats.rippling.com",),
}
SUBDOMAIN_TENANTS = {
    "recruitee": ("recruitee.com",),
    "teamtailor": ("teamtailor.com",),
    "breezy": ("breezy.hr",),
    "bamboohr": ("bamboohr.com",),
    "gupy": ("gupy.io",),
    "personio": ("jobs.personio.com", "jobs.personio.de"),
    "pinpoint": ("pinpointhq.com",),
    "jazzhr": ("applytojob.com",),
    "avature": ("avature.net",),
    "eightfold": ("eightfold.ai",),
    "softgarden": ("career.softgarden.de",),
}
_LABEL, _SEGMENT = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?", "[A-Za-z0-9][A-Za-z0-9_-]*"
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: (source, shape of host and path, tenant), for those that are neither; a shape must match as a whole.
TENANT_SHAPES = (
    ("herp", rf"herp\.careers/v1/({_LABEL})(?:/.*)?", "$1"),
    ("hrmos", rf"hrmos\.co/pages/({_LABEL})(?:/.*)?", "$1"),
    ("join_com", r"join\.com/companies/([A-Za-z0-9][A-Za-z0-9._-]*)(?:/.*)?", "$1"),
    ("paycom", r"paycomonline\.net/v4/ats/web\.php/portal/([0-9a-fA-F]{32})(?:/.*)?", "$1"),
    ("jobvite", rf"jobs\.jobvite\.com/((?:careers/)?(?!(?i:careers|jobs|search|viewall)(?:/|$)){_SEGMENT})(?:/.*)?", "$1"),
    ("pageup", r"careers\.pageuppeople\.com/(?:(?i:mob)/)?([0-9]+/[A-Za-z0-9-]+/[A-Za-z]{2}(?:-[A-Za-z]{2})?)(?:/.*)?", "$1"),
    ("paylocity", rf"recruiting\.paylocity\.com/(?i:recruiting/jobs/all)/({_UUID})", "$1"),
    ("moka", r"(hire-r1)\.mokahr\.com/social-recruitment/([A-Za-z0-9][A-Za-z0-9._-]*)/([0-9]+)(?:/.*)?", "$1/$2/$3"),
    ("moka", r"(hire-r1)\.mokahr\.com/campus-recruitment/([A-Za-z0-9][A-Za-z0-9._-]*)/([0-9]+)(?:/.*)?", "$1/$2/$3/campus"),
    ("moka", r"app\.mokahr\.com/social-recruitment/([A-Za-z0-9][A-Za-z0-9._-]*)/([0-9]+)(?:/.*)?", "$1/$2"),
    ("moka", r"app\.mokahr\.com/campus-recruitment/([A-Za-z0-9][A-Za-z0-9._-]*)/([0-9]+)(?:/.*)?", "$1/$2/campus"),
    ("dayforce", rf"jobs\.dayforcehcm\.com/(?:[A-Za-z]{{2}}(?:-[A-Za-z]{{2}})?/)??({_SEGMENT}/{_SEGMENT})(?:/(?i:jobs)(?:/[0-9]+(?:/(?i:apply))?)?)?", "$1"),
    ("ukg", rf"(recruiting[0-9]*\.ultipro\.(?:com|ca)/[A-Za-z0-9]+)/(?i:jobboard)/({_UUID})(?:/.*)?", "https://$1/JobBoard/$2"),
    ("keka", rf"({_LABEL}\.keka\.com)/(?i:careers)(?:/(?i:applyjob|jobdetails)/[0-9]+)?", "https://$1/careers"),
    ("keka", rf"({_LABEL}\.keka\.com)/(?i:careers)/((?!(?i:api|applyjob|content|jobdetails)(?:/|$)){_SEGMENT})(?:/(?i:applyjob|jobdetails)/[0-9]+)?", "https://$1/careers/$2"),
    ("darwinbox", rf"({_LABEL})\.darwinbox\.in(?:/.*)?", "$1"),
    ("darwinbox", rf"({_LABEL})\.darwinbox\.com(?:/.*)?", "$1.com"),
)
#: Sources whose tenant is the whole careers URL, and those whose tenant is lower-cased.
URL_TENANTS = {"workday": r"[^./]+\.wd[0-9]+\.myworkdayjobs\.com(?:/.*)?", "taleo": r"[^./]+\.tbe\.taleo\.net(?:/.*)?", "icims": r"[a-z0-9-]+\.icims\.com(?:/.*)?"}
LOWER_TENANTS = ("paycom", "paylocity")
CAREER_PATH = r"(?i)/(careers?|jobs?|join-us|work-with-us|vacanc(?:y|ies)|openings?|positions?|opportunities)(?:[/?#._-]|$)"
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def host(c: Column) -> Column:
    x = F.lower(F.regexp_replace(F.regexp_extract(c, _SHAPE, 2), r"^[^@]*@|:\d+$", ""))
    return F.nullif(x, F.lit(""))


def base_domain(c: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(c), ".", -2)


def canonical(c: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Scheme and host lower-cased, tracking parameters, fragment and a slash at the end dropped."""
    part = lambda i: F.regexp_extract(c, _SHAPE, i)
    kept = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*tracking)), "&")
    path = F.regexp_replace(part(3), r"/+$", "")
    built = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(c.rlike(_SHAPE), built).otherwise(c)


def without_tracking(c: Column, beginnings: tuple[str, ...] = TRACKING_BEGINNINGS) -> Column:
    """The URL as it is but for parameters whose names begin so, its fragment and slashes at its end."""
    part = lambda i: F.regexp_extract(c, _SHAPE, i)
    kept = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike("^(?:" + "|".join(beginnings) + ")")), "&")
    built = F.concat(part(1), F.lit("://"), part(2), part(3), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(c.rlike(_SHAPE), F.regexp_replace(built, "/+$", "")).otherwise(c)


def under(h: Column, domain: str) -> Column:
    return (h == domain) | F.endswith(h, F.lit("." + domain))


def url_class(c: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """The first class that has the host or a parent of it, else other."""
    out = None
    for name, domains in classes.items():
        hit = F.lit(False)
        for d in domains:
            hit = hit | under(host(c), d)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit("other") if out is None else out.otherwise(F.lit("other"))


def unwrap(c: Column, parameter: str = "q") -> Column:
    """The target in a redirect's parameter, else the URL itself."""
    found = F.regexp_extract(c, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(found.rlike("^https?(%3A|:)"), F.try_url_decode(found)).otherwise(c)


def board_token(c: Column, domain: str) -> Column:
    """The first path segment below a job board's domain."""
    return F.when(under(host(c), domain), F.nullif(F.regexp_extract(c, r"^[a-z]+://[^/]+/([^/?#]+)", 1), F.lit("")))


def tenant(c: Column) -> Column:
    """struct(source, slug) of a careers URL, with or without a scheme; null where no known shape fits."""
    url = F.when(c.contains("//"), c).otherwise(F.concat(F.lit("https://"), c))
    h = F.regexp_replace(host(url), r"^www\.", "")
    spot = F.concat(h, F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _SHAPE, 3), "/+", "/"), "/$", ""))
    # bound once by a lambda: repeated in each branch, the parts of the URL make code too large to compile
    return F.get(F.transform(F.array(F.struct(url.alias("url"), h.alias("host"), spot.alias("spot"))), _tenant), 0)


def _tenant(r: Column) -> Column:
    made = lambda source, slug: F.struct(F.lit(source).alias("source"), slug.alias("slug"))
    first = r"^[^/]*/([A-Za-z0-9][A-Za-z0-9._-]*)(?:/.*)?$"
    out = F.when(r["spot"].isNull(), F.lit(None))
    for source, hosts in PATH_TENANTS.items():
        out = out.when(r["host"].isin(*hosts), F.when(r["spot"].rlike(first), made(source, F.regexp_extract(r["spot"], first, 1))))
    for source, shape, slug in TENANT_SHAPES:
        found = F.regexp_replace(r["spot"], f"^{shape}$", slug)
        out = out.when(r["spot"].rlike(f"^{shape}$"), made(source, F.lower(found) if source in LOWER_TENANTS else found))
    for source, domains in SUBDOMAIN_TENANTS.items():
        shape = rf"^({_LABEL})\.(?:{'|'.join(d.replace('.', chr(92) + '.') for d in domains)})$"
        out = out.when(r["host"].rlike(shape), made(source, F.regexp_extract(r["host"], shape, 1)))
    for source, shape in URL_TENANTS.items():
        out = out.when(r["spot"].rlike(f"^{shape}$"), made(source, r["url"]))
    return out


def is_career_path(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, _SHAPE, 3).rlike(CAREER_PATH), F.lit(False))


def unwrap_base64(c: Column, parameter: str = "u", mark: str = "a1") -> Column:
    """The target in a redirect's URL-safe base64 parameter behind a mark, else the URL itself."""
    code = F.translate(F.regexp_extract(c, rf"[?&]{parameter}={mark}([A-Za-z0-9_-]+)", 1), "-_", "+/")
    plain = F.decode(F.try_to_binary(F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "="), F.lit("base64")), "UTF-8")
    return F.when(plain.rlike("^https?://"), plain).otherwise(c)


def is_public(c: Column) -> Column:
    """http(s) with a host of two labels or more that is neither an address nor a local name; no user part."""
    h = host(c)
    good = c.rlike("(?i)^https?://[^/?#@]+") & ~c.rlike(r"^[^/]*//[^/?#]*@") & h.rlike(rf"^(?:{_LABEL}\.)+[a-z]{{2,}}$") & ~h.rlike(r"(^|\.)(localhost|local|internal)$")
    return F.coalesce(good, F.lit(False))


def is_host_label(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{_LABEL}$"), F.lit(False))
