"""Parsers of landed payloads (one per row) into postings, by name of the provider's format.

Fetching is not done here: a landing job writes what a provider answered, one payload a row, and Spark parses it.
A provider is a name with a parser; formats that differ only in field names share one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.functions import text, values

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(*names: str):
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        PARSERS.update(dict.fromkeys(names, f))
        return f

    return register


def parse(provider: str, landed: DataFrame) -> DataFrame:
    """Postings of one provider; landed: company, payload. Rows of unknown providers raise."""
    if provider not in PARSERS:
        raise KeyError(f"no parser for {provider}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[provider](landed).withColumn("ats_type", F.lit(provider)).withColumn("global_id", values.global_id(F.col("ats_type"), F.col("ats_id")))


def json_list(items: str, schema: str, explode: str | None = None, keep: str = "true", **columns: str):
    """A parser of a JSON list (at items, a path with dots, or the root where it is "") by column expressions over its fields.

    keep: a condition on the columns; other rows go. A column named company replaces the landed one where it is not null.
    """

    def run(landed: DataFrame) -> DataFrame:
        kind = f"array<struct<{schema}>>"
        for name in reversed(items.split(".") if items else []):
            kind = f"struct<{name}: {kind}>"
        whole = F.from_json("payload", kind)
        for name in items.split(".") if items else []:
            whole = whole[name]
        rows = landed.select("company", F.explode(whole).alias("j")).where("j is not null")
        if explode:  # lists within the list's elements: their own elements are r
            rows = rows.select("company", F.explode(F.col("j")[explode]).alias("r"))
        company = F.coalesce(F.expr(columns["company"]), "company") if "company" in columns else F.col("company")
        return rows.select(company.alias("company"), *(F.expr(e).alias(c) for c, e in columns.items() if c != "company")).where(keep)

    return run


PARSERS["greenhouse"] = json_list("jobs", "id string, title string, absolute_url string, updated_at string, content string, location struct<name: string>", ats_id="j.id", title="j.title", url="j.absolute_url", location="j.location.name", description="j.content", posted_at="try_to_timestamp(j.updated_at)")
PARSERS["lever"] = json_list("", "id string, text string, hostedUrl string, createdAt bigint, descriptionPlain string, categories struct<location: string, team: string, commitment: string>", ats_id="j.id", title="j.text", url="j.hostedUrl", location="j.categories.location", team="j.categories.team", commitment="j.categories.commitment", description="j.descriptionPlain", posted_at="timestamp_millis(j.createdAt)")
PARSERS["ashby"] = json_list("jobs", "id string, title string, jobUrl string, location string, isRemote boolean, publishedAt string, descriptionPlain string, department string", ats_id="j.id", title="j.title", url="j.jobUrl", location="j.location", is_remote="j.isRemote", department="j.department", description="j.descriptionPlain", posted_at="try_to_timestamp(j.publishedAt)")
PARSERS["smartrecruiters"] = json_list("content", "id string, name string, ref string, releasedDate string, location struct<city: string, region: string, country: string>", ats_id="j.id", title="j.name", url="j.ref", location="concat_ws(', ', j.location.city, j.location.region, upper(j.location.country))", country_iso="upper(j.location.country)", posted_at="try_to_timestamp(j.releasedDate)")
PARSERS["workable"] = json_list("jobs", "shortcode string, title string, url string, city string, country string, telecommuting boolean, published_on string, department string", ats_id="j.shortcode", title="j.title", url="j.url", location="concat_ws(', ', j.city, j.country)", is_remote="j.telecommuting", department="j.department", posted_at="try_to_timestamp(j.published_on)")
PARSERS["recruitee"] = json_list("offers", "id string, title string, careers_url string, location string, remote boolean, created_at string, description string, department string", ats_id="j.id", title="j.title", url="j.careers_url", location="j.location", is_remote="j.remote", department="j.department", description="j.description", posted_at="try_to_timestamp(j.created_at)")

PARSERS["breezy"] = json_list("", "id string, name string, url string, published_date string, location struct<name: string>, department string", ats_id="j.id", title="j.name", url="j.url", location="j.location.name", department="j.department", posted_at="try_to_timestamp(j.published_date)")
PARSERS["bamboohr"] = json_list("result", "id string, jobOpeningName string, departmentLabel string, location struct<city: string, state: string>", ats_id="j.id", title="j.jobOpeningName", url="cast(null as string)", location="concat_ws(', ', j.location.city, j.location.state)", department="j.departmentLabel")
PARSERS["pinpoint"] = json_list("data", "id string, title string, url string, location struct<name: string>, employment_type string", ats_id="j.id", title="j.title", url="j.url", location="j.location.name", commitment="j.employment_type")
PARSERS["rippling"] = json_list("", "uuid string, name string, url string, workLocation struct<label: string>, department struct<label: string>", ats_id="j.uuid", title="j.name", url="j.url", location="j.workLocation.label", department="j.department.label")
PARSERS["arbetsformedlingen"] = json_list("hits", "id string, headline string, webpage_url string, publication_date string, description struct<text: string>, workplace_address struct<municipality: string>", ats_id="j.id", title="j.headline", url="j.webpage_url", location="j.workplace_address.municipality", description="j.description.text", posted_at="try_to_timestamp(j.publication_date)")
PARSERS["bundesagentur"] = json_list("stellenangebote", "refnr string, titel string, externeUrl string, aktuelleVeroeffentlichungsdatum string, arbeitsort struct<ort: string, region: string, land: string>", ats_id="j.refnr", title="j.titel", url="j.externeUrl", location="concat_ws(', ', j.arbeitsort.ort, j.arbeitsort.region, j.arbeitsort.land)", posted_at="try_to_timestamp(j.aktuelleVeroeffentlichungsdatum)")
PARSERS["amazon"] = json_list("jobs", "id_icims string, id string, title string, job_path string, location string, description string, posted_date string, job_category string, job_schedule_type string", ats_id="coalesce(j.id_icims, j.id)", title="j.title", url="concat('https://www.amazon.jobs', j.job_path)", location="j.location", department="j.job_category", commitment="j.job_schedule_type", description="j.description", posted_at="try_to_timestamp(j.posted_date, 'MMMM d, yyyy')")
PARSERS["remoteok"] = json_list("", "id string, position string, company string, url string, location string, salary_min double, salary_max double, description string, epoch bigint", ats_id="j.id", title="j.position", url="j.url", location="j.location", salary_min="nullif(j.salary_min, 0)", salary_max="nullif(j.salary_max, 0)", is_remote="true", description="j.description", posted_at="timestamp_seconds(j.epoch)")
PARSERS["usajobs"] = json_list("SearchResult.SearchResultItems", "MatchedObjectDescriptor struct<PositionID: string, PositionTitle: string, PositionURI: string, OrganizationName: string, PublicationStartDate: string, PositionLocation: array<struct<LocationName: string>>, PositionRemuneration: array<struct<MinimumRange: string, MaximumRange: string>>>", ats_id="j.MatchedObjectDescriptor.PositionID", title="j.MatchedObjectDescriptor.PositionTitle", url="j.MatchedObjectDescriptor.PositionURI", location="array_join(j.MatchedObjectDescriptor.PositionLocation.LocationName, '; ')", department="j.MatchedObjectDescriptor.OrganizationName", salary_min="try_cast(get(j.MatchedObjectDescriptor.PositionRemuneration, 0).MinimumRange as double)", salary_max="try_cast(get(j.MatchedObjectDescriptor.PositionRemuneration, 0).MaximumRange as double)", posted_at="try_to_timestamp(j.MatchedObjectDescriptor.PublicationStartDate)")
PARSERS["workday"] = json_list("jobPostings", "title string, externalPath string, locationsText string, postedOn string, bulletFields array<string>", ats_id="coalesce(get(j.bulletFields, 0), nullif(regexp_extract(j.externalPath, '([^/]+)$', 1), ''))", title="coalesce(nullif(j.title, ''), 'Untitled')", url="j.externalPath", location="j.locationsText", posted_text="j.postedOn")
PARSERS["oracle"] = json_list("items", "requisitionList array<struct<Id: string, Title: string, PrimaryLocation: string, PostedDate: string, ExternalURL: string>>", ats_id="r.Id", title="r.Title", url="r.ExternalURL", location="r.PrimaryLocation", posted_at="try_to_timestamp(r.PostedDate)", explode="requisitionList")
PARSERS["gem"] = json_list("data.oatsExternalJobPostings.jobPostings", "extId string, title string, locations array<struct<name: string, city: string, isoCountry: string, isRemote: boolean>>, job struct<employmentType: string, department: struct<name: string>>", ats_id="j.extId", title="j.title", url="cast(null as string)", location="array_join(j.locations.name, '; ')", country_iso="get(j.locations, 0).isoCountry", is_remote="exists(j.locations, x -> x.isRemote)", department="j.job.department.name", commitment="j.job.employmentType")
PARSERS["ycombinator"] = json_list("jobPostings", "id string, title string, url string, location string, salaryRange string, minExperience string, type string, createdAt string, prettyRole string", ats_id="j.id", title="j.title", url="concat('https://www.ycombinator.com', j.url)", location="j.location", department="j.prettyRole", commitment="j.type", salary_text="j.salaryRange", experience_text="j.minExperience", posted_text="j.createdAt")


#: What a provider's row must have.
NAMED = "ats_id <> '' and title <> ''"

PARSERS["join_com"] = json_list(
    "items",
    "id string, idParam string, title string, url string, location string, city string, department string, employmentType string, "
    "publishedAt string, createdAt string",
    keep=NAMED,
    ats_id="j.id",
    title="trim(j.title)",
    # The page of a job goes by idParam; its number is known to the API only.
    url="coalesce(j.url, concat('https://join.com/companies/', company, '/jobs/', coalesce(j.idParam, j.id)))",
    # Each may be a text or an object, which from_json hands over as its JSON.
    location="coalesce(if(j.location like '{%', null, nullif(trim(j.location), '')), nullif(concat_ws(', ', nullif(get_json_object(coalesce(j.city, j.location), '$.cityName'), ''), "
    "nullif(get_json_object(coalesce(j.city, j.location), '$.countryName'), '')), ''))",
    department="nullif(trim(if(j.department like '{%', get_json_object(j.department, '$.name'), j.department)), '')",
    commitment="nullif(trim(if(j.employmentType like '{%', get_json_object(j.employmentType, '$.name'), j.employmentType)), '')",
    posted_at="try_to_timestamp(coalesce(j.publishedAt, j.createdAt))",
)
PARSERS["gupy"] = json_list(
    "props.pageProps.jobs",
    "id string, title string, name string, department string, type string, jobUrl string, publishedAt string, "
    "workplace struct<workplaceType: string, address: struct<city: string, state: string, country: string>>",
    keep=NAMED,
    ats_id="trim(j.id)",
    title="trim(coalesce(nullif(j.title, ''), j.name))",
    url="case when trim(j.jobUrl) like '/%' then concat('https://', company, '.gupy.io', j.jobUrl) when trim(j.jobUrl) <> '' then j.jobUrl else concat('https://', company, '.gupy.io/jobs/', j.id) end",
    location="nullif(concat_ws(', ', nullif(trim(j.workplace.address.city), ''), nullif(trim(j.workplace.address.state), ''), nullif(trim(j.workplace.address.country), '')), '')",
    country_iso="if(coalesce(lower(trim(j.workplace.address.country)), '') in ('', 'brasil', 'brazil'), 'BR', null)",
    is_remote="case lower(trim(j.workplace.workplaceType)) when 'remote' then true when 'on-site' then false end",
    department="trim(j.department)",
    commitment="j.type",
    posted_at="try_to_timestamp(j.publishedAt)",
)
PARSERS["thehub"] = json_list(
    "docs",
    "id string, _id string, title string, status string, company struct<name: string>, location struct<address: string, locality: string, country: string>, "
    "isRemote boolean, description string, publishedAt string, approvedAt string, createdAt string, link string",
    keep=NAMED + " and status = 'ACTIVE'",
    company="coalesce(nullif(trim(j.company.name), ''), 'Unknown')",
    ats_id="trim(coalesce(nullif(j.id, ''), j._id))",
    title="trim(j.title)",
    status="upper(j.status)",
    url="concat('https://thehub.io/jobs/', trim(coalesce(nullif(j.id, ''), j._id)))",
    location="coalesce(nullif(trim(j.location.address), ''), nullif(concat_ws(', ', nullif(trim(j.location.locality), ''), nullif(trim(j.location.country), '')), ''))",
    is_remote="coalesce(j.isRemote, false)",
    apply_url="if(trim(j.link) rlike '^https?://', trim(j.link), null)",
    description="j.description",
    posted_at="try_to_timestamp(coalesce(j.publishedAt, j.approvedAt, j.createdAt))",
)
PARSERS["uber"] = json_list(
    "jobs",
    "Id string, Title string, Locations array<struct<Address: string, City: string, Region: string, Country: string, CountryCode: string>>, "
    "Urls array<struct<Url: string, IsDefault: boolean>>, Remote boolean, AdditionalText string, Reference string, ContractType string, WorkPattern string, "
    "Salary struct<Currency: string, MinValue: double, MaxValue: double>, Description string, DisplayDate string",
    keep=NAMED,
    company="'Uber'",
    ats_id="trim(j.Id)",
    title="trim(j.Title)",
    url="case when coalesce(get(filter(j.Urls, x -> x.IsDefault), 0).Url, get(j.Urls, 0).Url) like '/%' then concat('https://jobs.uber.com', coalesce(get(filter(j.Urls, x -> x.IsDefault), 0).Url, get(j.Urls, 0).Url)) "
    "else coalesce(get(filter(j.Urls, x -> x.IsDefault), 0).Url, get(j.Urls, 0).Url, concat('https://jobs.uber.com/en/jobs/', j.Id, '/')) end",
    location="nullif(array_join(array_distinct(transform(j.Locations, x -> coalesce(nullif(trim(x.Address), ''), array_join(array_distinct(filter(array(trim(x.City), trim(x.Region), trim(x.Country)), y -> y <> '')), ', ')))), '; '), '')",
    country_iso="if(length(get(j.Locations, 0).CountryCode) = 2, upper(get(j.Locations, 0).CountryCode), null)",
    is_remote="j.Remote",
    salary_currency="if(length(j.Salary.Currency) = 3, upper(j.Salary.Currency), null)",
    salary_min="j.Salary.MinValue",
    salary_max="j.Salary.MaxValue",
    department="j.AdditionalText",
    requisition_id="coalesce(nullif(j.Reference, ''), j.Id)",
    commitment="nullif(array_join(array_distinct(filter(array(j.ContractType, j.WorkPattern), x -> x <> '')), ' / '), '')",
    description="j.Description",
    posted_at="try_to_timestamp(j.DisplayDate)",
)
PARSERS["wanted"] = json_list(
    "data",
    "id string, position string, company struct<name: string>, address struct<district: string, location: string, country: string, full_location: string>, annual_from int",
    keep=NAMED,
    company="coalesce(nullif(trim(j.company.name), ''), 'Unknown')",
    ats_id="j.id",
    title="trim(j.position)",
    url="concat('https://www.wanted.co.kr/wd/', j.id)",
    location="coalesce(nullif(array_join(array_distinct(filter(array(trim(j.address.district), trim(j.address.location), trim(j.address.country)), x -> x <> '')), ', '), ''), nullif(trim(j.address.full_location), ''))",
    experience="j.annual_from",
)
PARSERS["recruiterbox"] = json_list(
    "objects",
    "id string, title string, hosted_url string, url string, client_name string, allows_remote boolean, team string, position_type string, "
    "location struct<city: string, state: string, country: string>, description string, created_on string, updated_on string",
    keep=NAMED + " and url <> ''",
    company="nullif(trim(j.client_name), '')",
    ats_id="trim(j.id)",
    title="trim(j.title)",
    url="coalesce(nullif(j.hosted_url, ''), j.url)",
    location="nullif(concat_ws(', ', nullif(trim(j.location.city), ''), nullif(trim(j.location.state), ''), nullif(trim(j.location.country), '')), '')",
    is_remote="j.allows_remote",
    team="nullif(j.team, '')",
    commitment="j.position_type",
    description="j.description",
    posted_at="try_to_timestamp(coalesce(nullif(j.created_on, ''), j.updated_on))",
)
PARSERS["mercor"] = json_list(
    "listings",
    "listingId string, title string, companyName string, location string, rateMin double, rateMax double, commitment string, hoursPerWeek double, "
    "workArrangement string, description string, postedAt string",
    keep=NAMED,
    company="coalesce(nullif(trim(j.companyName), ''), 'Mercor')",
    ats_id="trim(j.listingId)",
    title="trim(j.title)",
    url=r"concat('https://work.mercor.com/jobs/', trim(j.listingId), '/', trim('-' from regexp_replace(regexp_replace(lower(trim(j.title)), r'(?U)[^\w\s-]', ''), r'(?U)[-\s]+', '-')))",
    location="nullif(trim(j.location), '')",
    is_remote="case when lower(trim(j.workArrangement)) = 'remote' then true when lower(trim(j.workArrangement)) in ('onsite', 'on-site', 'in-office', 'office') then false end",
    salary_min="j.rateMin",
    salary_max="j.rateMax",
    salary_currency="if(j.rateMin <> 0 or j.rateMax <> 0, 'USD', null)",
    employment_type="'CONTRACT'",
    commitment="nullif(concat_ws(' · ', concat(upper(left(nullif(trim(j.commitment), ''), 1)), lower(substr(trim(j.commitment), 2))), if(j.hoursPerWeek > 0, concat(cast(j.hoursPerWeek as int), 'h/week'), null)), '')",
    description="nullif(trim(j.description), '')",
    posted_at="try_to_timestamp(j.postedAt)",
)
PARSERS["manfred"] = json_list(
    "",
    "slug string, position string, status string, company struct<name: string>, locations array<string>, remotePercentage double, salaryFrom double, salaryTo double, "
    "currency string, internalCode string, updatedAt string",
    keep=NAMED + " and status = 'ACTIVE'",
    company="coalesce(nullif(trim(j.company.name), ''), 'Unknown')",
    ats_id="trim(j.slug)",
    title="trim(j.position)",
    status="upper(j.status)",
    url="concat('https://www.getmanfred.com/job-offers/', trim(j.slug))",
    location="nullif(array_join(slice(filter(transform(j.locations, x -> trim(x)), x -> x <> ''), 1, 5), ' | '), '')",
    is_remote="j.remotePercentage >= 50",
    salary_min="if(j.salaryFrom > 0, j.salaryFrom, null)",
    salary_max="if(j.salaryTo > 0, j.salaryTo, null)",
    salary_currency="if(j.salaryFrom > 0 or j.salaryTo > 0, coalesce(map('€', 'EUR', '$', 'USD', '£', 'GBP', '¥', 'JPY', '₣', 'CHF', 'kr', 'SEK')[coalesce(nullif(j.currency, ''), '€')], upper(left(j.currency, 3))), null)",
    requisition_id="j.internalCode",
    posted_at="try_to_timestamp(j.updatedAt)",
)


@parser("rss", "teamtailor", "personio_feed")
def rss(landed: DataFrame) -> DataFrame:
    """RSS 2.0: one posting an item."""
    items = F.regexp_extract_all("payload", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    rows = landed.select("company", F.explode(items).alias("item"))

    def field(name: str) -> F.Column:
        x = F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
        return F.nullif(x, F.lit(""))

    return rows.select("company", field("guid").alias("ats_id"), text.html_text(field("title")).alias("title"), field("link").alias("url"), field("location").alias("location"), field("description").alias("description"), values.feed_time(field("pubDate")).alias("posted_at"))


@parser("personio")
def personio(landed: DataFrame) -> DataFrame:
    """The XML feed of positions."""
    items = F.regexp_extract_all("payload", F.lit(r"(?is)<position>(.*?)</position>"), F.lit(1))
    rows = landed.select("company", F.explode(items).alias("item"))
    field = lambda name: F.nullif(text.html_text(F.regexp_extract("item", rf"(?is)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)), F.lit(""))
    return rows.select("company", field("id").alias("ats_id"), field("name").alias("title"), F.lit(None).cast("string").alias("url"), field("office").alias("location"), field("department").alias("department"), field("employmentType").alias("commitment"), values.iso_time(field("createdAt")).alias("posted_at"))


def job_posting(landed: DataFrame) -> DataFrame:
    """company, url, ats_id, title, location, posted_at from schema.org JobPosting objects in pages (company, url, payload)."""
    blocks = F.regexp_extract_all("payload", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    kind = "struct<`@type`: string, title: string, identifier: struct<value: string>, datePosted: string, jobLocation: struct<address: struct<addressLocality: string, addressCountry: string>>>"
    rows = landed.select("company", "url", F.explode(blocks).alias("block")).select("company", "url", F.from_json("block", kind).alias("j"))
    place = F.col("j.jobLocation.address")
    return rows.where(F.col("j.`@type`") == "JobPosting").select("company", "url", F.col("j.identifier.value").alias("ats_id"), F.col("j.title").alias("title"), F.concat_ws(", ", place["addressLocality"], place["addressCountry"]).alias("location"), values.iso_time(F.col("j.datePosted")).alias("posted_at"))
