"""Column types shared by the operators."""

# A detected span. Offsets count code points, half-open.
SPAN = ("struct<start:int,end:int,text:string,entity_type:string,"
        "score:double,source:string>")
SPANS = f"array<{SPAN}>"

# A candidate: a span with the reason for which it was turned down (null = still in).
CANDIDATE = ("struct<start:int,end:int,text:string,entity_type:string,"
             "score:double,source:string,reason:string>")
CANDIDATES = f"array<{CANDIDATE}>"

# What an external model reports for one text.
RAW_SPAN = "struct<start:int,end:int,text:string,label:string,score:double>"
RAW_SPANS = f"array<{RAW_SPAN}>"

INTERVALS = "array<struct<start:int,end:int>>"

# One formatted fragment of a paragraph.
RUN = "struct<run_no:int,run_text:string>"
RUNS_TABLE = "story string, para_no int, run_no int, run_text string"

MAPPING = "original string, entity_type string, replacement string"

GROUND_TRUTH = ("documents array<struct<id:string,text:string,"
                "entities:array<struct<start:int,end:int,entity_type:string>>>>")

REVIEW = ("original string, replacement string, original_occurrences bigint, "
          "replacement_occurrences bigint, source_context string, "
          "is_actual_pii string, entity_type string, notes string")

METRICS = "position int, metric string, value string"
