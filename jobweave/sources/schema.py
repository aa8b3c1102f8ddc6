"""Columns of the model tables, for reads that must not guess."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "jobs": """id bigint, organisation_name string, org_location string, career_page_available string,
        career_page_url string, validation_reason string, application_type string, job_title string,
        job_description string, job_link string, location string, salary string, dateposted string,
        added_at timestamp_ntz, job_category_id int, remote_type string, experience_level string, job_type_id int,
        job_source string, company_url string, is_active int, views_count int, exists_in_uk int, exists_in_london int,
        has_description int, last_health_check timestamp_ntz, deactivation_reason string""",
    "job_embeddings": "id bigint, embedding array<float>, embedding_dimension int",
    "users": """user_id bigint, username string, first_name string, last_name string, job_role_profession string,
        membership_status int, saved_jobs string, created_at timestamp_ntz, last_login timestamp_ntz""",
    "user_usage": """usage_id bigint, user_id bigint, date timestamp_ntz, search_keywords string,
        filters_applied string, companies_applied string""",
    "payments": """payment_id bigint, user_id bigint, amount decimal(12,2), transaction_id string, status string,
        created_at timestamp_ntz""",
    "queries": """query_id bigint, query string, filters map<string,string>, user_id bigint, page int, page_limit int,
        location_filter string, query_embedding array<float>""",
    "pages": "page_id bigint, url string, html string",
    "fetch_log": """job_id bigint, job_link string, head_status int, head_final_url string, get_status int,
        final_url string, body string, error string""",
    "org_links": """row_index bigint, organisation_name string, town string, county string, search_query string,
        links array<struct<url:string,title:string,rank:int>>""",
    "model_outputs": "org_id bigint, career_url string, raw string",
}


def read_model(spark: SparkSession, path: str, name: str, file_format: str = "parquet", **options: str) -> DataFrame:
    """A model table with its declared columns; columns a file lacks are null."""
    return spark.read.format(file_format).schema(SCHEMAS[name]).options(**options).load(path)
