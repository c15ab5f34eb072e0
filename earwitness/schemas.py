"""Table schemas of the JSON documents this engine reads."""

from __future__ import annotations

from pyspark.sql.types import StructType

SEGMENT = (
    "struct<chunk_filename:string,segment_id:string,start_sec:double,end_sec:double,start:double,end:double,"
    "global_start_sec:double,global_end_sec:double,segment_timing_scope:string,text:string,"
    "speaker:string,provider_speaker:string>")

PROVIDER_CHUNK = (
    "struct<chunk_filename:string,filename:string,chunk_start_sec:double,chunk_end_sec:double,start_sec:double,end_sec:double,"
    "duration_seconds:double,segment_timing_scope:string,provider_code:string,model:string,run_id:string,"
    f"transcript_path:string,provider_artifact_path:string,chunk_sha256:string,text:string,segments:array<{SEGMENT}>>")


def ddl(text: str) -> StructType:
    return StructType.fromDDL(text)


def provider_document() -> StructType:
    return ddl(f"schema_version string, job_id string, model string, chunks array<{PROVIDER_CHUNK}>, "
               f"segments array<{SEGMENT}>, _corrupt_record string")


def chunk_transcript() -> StructType:
    return ddl(
        "schema_version string, job_id string, chunk_filename string, chunk_sha256 string, source_sha256 string, "
        "transcript_path string, provider_artifact_path string, duration_seconds double, chunk_start_sec double, "
        "chunk_end_sec double, segment_timing_scope string, provider string, provider_code string, model string, "
        f"run_id string, response_format string, diarized boolean, text string, segments array<{SEGMENT}>, _corrupt_record string")


def job() -> StructType:
    return ddl(
        "job_id string, state string, created_at timestamp, updated_at timestamp, "
        "source struct<original_filename:string,filename:string,sha256:string,size_bytes:bigint>, "
        "preprocess struct<duration_seconds:double,blob_duration_seconds:double>, "
        "quality struct<overall_status:string,review_url:string,unresolved_windows:bigint,providers:map<string,string>,stages:map<string,string>>, "
        "outputs map<string,string>, errors array<struct<ts:string,step:string,type:string,message:string>>, "
        "output_errors array<struct<ts:string,step:string,type:string,message:string>>, attempts map<string,int>, "
        "chunks array<struct<filename:string>>, transcripts array<struct<transcript_path:string>>, "
        "transcription struct<state:string,retryable:boolean>, "
        "estimated_cost_usd double, actual_cost_usd double, _corrupt_record string")


def eval_case() -> StructType:
    return ddl("id string, language string, reference string, hypothesis string, provider string, model string, "
               "duration_seconds double, cost_usd double, contract_errors array<string>")


def model_registry() -> StructType:
    return ddl("model_id string, provider string, provider_code string, tier_label string, response_format string, "
               "diarization boolean, price_per_minute_usd double, adapter_ready boolean, gate_enabled boolean, "
               "credential_available boolean, cost_cap_included boolean, position int")
