"""Read schemas of raw records and schemas of the tables they become."""

from __future__ import annotations

PERSON = "struct<first_name: string, last_name: string>"
FILINGS_JSON = f"""filing_uuid string, filing_type string, filing_year int, filing_period string, income string, expenses string, dt_posted string,
registrant struct<id: bigint, name: string, house_registrant_id: bigint>, client struct<id: bigint, name: string, state: string, country: string>,
lobbying_activities array<struct<general_issue_code: string, description: string, government_entities: array<struct<name: string>>,
lobbyists: array<struct<lobbyist: {PERSON}, first_name: string, last_name: string, covered_position: string>>>>"""
CONTRIBUTIONS_JSON = f"""filing_uuid string, filing_type string, filing_year int, filing_period string, filer_type string, no_contributions boolean,
registrant struct<id: bigint, name: string>, lobbyist {PERSON},
contribution_items array<struct<contribution_type: string, contributor_name: string, payee_name: string, honoree_name: string, amount: string, date: string>>"""
FILING_XML = """senateID string, organizationName string, clientName string, reportYear string, income string, expenses string,
alis struct<ali_info: array<struct<issueAreaCode: string, specific_issues: struct<description: string>, federal_agencies: string>>>"""
RELEASES_JSONL = """url string, title string, date string, date_source string, source string, domain string, scraper string,
member struct<bioguide_id: string, name: string, party: string, state: string, chamber: string>, text string, collected_at string, updated_at string"""
ROLL_CALLS = {
    "members": "icpsr string, bioguide_id string, party_code string, bioname string, state_abbrev string, nominate_dim1 string",
    "rollcalls": "rollnumber string, date string, bill_number string",
    "votes": "rollnumber string, icpsr string, cast_code string",
}
#: Tables, their keys and the column that partitions them.
TABLES = {
    "filings": (["filing_uuid"], "filing_year"),
    "activities": (["filing_uuid", "act_idx"], None),
    "activity_people": (["filing_uuid", "act_idx", "person_idx"], None),
    "contributions": (["filing_uuid"], "filing_year"),
    "contribution_items": (["filing_uuid", "item_idx"], None),
    "other_filings": (["house_id"], "report_year"),
    "other_activities": (["house_id", "ali_idx"], None),
    "releases": (["url"], None),
    "members": (["member_id"], None),
    "provenance_index": (["prov"], "dataset"),
}
