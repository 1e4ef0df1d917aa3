"""The canonical posting row."""

POSTING = (
    "global_id string, url string, title string, company string, ats_type string, ats_id string, location string, country_iso string, region string, lat double, lon double, "
    "is_remote boolean, salary_currency string, salary_period string, salary_summary string, salary_min double, salary_max double, experience int, employment_type string, "
    "department string, team string, requisition_id string, apply_url string, commitment string, description string, posted_at timestamp, fetched_at timestamp, application_deadline timestamp, language string, raw string"
)
COLUMNS = tuple(c.split()[0] for c in POSTING.split(", "))
PERIODS = ("HOUR", "DAY", "WEEK", "MONTH", "YEAR")
