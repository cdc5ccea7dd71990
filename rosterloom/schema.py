"""Schemas of the directory's tables."""

CONTACT = "struct<raw_name:string,first_name:string,middle_name:string,last_name:string,suffix:string,title:string,email:string,phone:string>"
CONTACT_FIELDS = ("raw_name", "first_name", "middle_name", "last_name", "suffix", "title", "email", "phone")
MANIFEST = (
    "struct<discoveryMethod:string,sourceRanges:array<struct<section:string,status:string,exhibit:string,printedStart:string,pdfStart:int,pdfEnd:int>>,pagesExamined:array<int>,ocrPages:array<int>,"
    "ocrConfidence:double,acceptedRows:bigint,rejectedRows:bigint,duplicateRows:bigint,missingAddressRows:bigint,missingContactRows:bigint,warnings:array<string>,complete:boolean,"
    "addedRows:bigint,matchedRows:bigint,updatedRows:bigint,unchangedRows:bigint,ambiguousRows:bigint,collapsedRows:bigint,removedRows:bigint>"
)
DOCUMENTS = (
    "id string, owner_id string, franchise_name string, fdd_year int, filename string, object_path string, upload_date timestamp, processing_status string, page_count int, data_as_of string, source_exhibit string, "
    f"published_counts map<string,bigint>, extraction_manifest {MANIFEST}, last_processed_at timestamp, created_at timestamp"
)
STAGES = "id bigint, document_id string, stage string, status string, message string, started_at timestamp, finished_at timestamp"
LOCATION_TEXT = (
    "document_id", "franchise_name", "franchisor", "status", "franchisee_entity", "address", "city", "state", "zip", "country", "phone", "email", "location_code", "exit_reason", "printed_page", "source_exhibit",
    "source_section", "raw_source_text", "review_status", "review_reason",
)
LOCATIONS = "id string, " + ", ".join(f"{c} string" for c in LOCATION_TEXT) + ", source_page int, confidence double, created_at timestamp, updated_at timestamp"
CONTACTS = "id string, location_id string, " + ", ".join(f"{c} string" for c in CONTACT_FIELDS)
#: Postings of what a search reads, with the bucket of their location; those of changed rows stay until the next compaction.
POSTINGS = "id string, gram string, held_in int"
#: Changes of the counts of locations by document and what is counted by; their sums are the counts.
TALLIES = "id string, document_id string, status string, review_status string, n bigint"
SEARCHED = ("franchisor", "franchisee_entity", "city", "state", "address", "location_code")
PAGES = "document_id string, pdf_page int, text string, ocr boolean, ocr_confidence double"
GLYPHS = "document_id string, pdf_page int, ordinal long, text string, x double, y double, width double, page_width double, page_height double"
CANDIDATES = (
    "document_id string, ordinal long, franchise_name string, franchisor string, status string, franchisee_entity string, address string, city string, state string, zip string, country string, phone string, email string, "
    "location_code string, exit_reason string, source_page int, printed_page string, source_exhibit string, source_section string, raw_source_text string, confidence double, review_status string, review_reason string"
)
EMPTY_TABLES = {"documents": DOCUMENTS, "stages": STAGES, "locations": LOCATIONS, "contacts": CONTACTS, "postings": POSTINGS, "tallies": TALLIES}
