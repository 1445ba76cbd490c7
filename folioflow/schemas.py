"""Schemas and fixed texts of the data model (D1-D13). One place for the status domain."""

from pyspark.sql import types as T

# States, texts and constants that results must carry exactly.
STATUSES = ("processing", "completed", "failed")
RESTART_ERROR = "Server restarted before task completed."
NO_MODEL_ERROR = "No configured OCR model is loaded at startup."
LAYOUT_MODE = "qwen_image_text_to_text"
BBOX_SOURCE = "qwen_generated_text"
CONFIDENCE_NOTE = "Qwen image-text-to-text generation does not expose calibrated OCR confidence scores."
REMOTE_PIPELINE = "vLLM OpenAI-compatible API"
LOCAL_PIPELINE = "AutoModelForImageTextToText"
MODEL_NAME = "qwen_ocr"
PROVIDERS = ("vllm", "transformers")
UNREACHABLE_ERROR = "Could not reach vLLM at {url}. Start it first, for example: `vllm serve {model} --host 0.0.0.0 --port 8000`."
PROVIDER_ERROR = "QWEN_OCR_PROVIDER must be either 'vllm' or 'transformers'."
PDF_PACKAGE_ERROR = "PDF OCR with Qwen requires the 'pymupdf' package."
UNKNOWN_MODEL_ERROR = "Unknown model name or optional dependency missing"
# End of the fixed values.

UPLOADS = T.StructType(
    [
        T.StructField("upload_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)
#: What the binaryFile source yields; a stream has to be told (T8).
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
PAGES = "task_id string, page_index int, image binary, error string"
PAGE_TEXTS = "task_id string, page_index int, page_text string, error string"
REJECTS = (
    "upload_id string, filename string, content_type string, size_bytes bigint, reject_code int, reject_detail string, "
    "rejected_at timestamp"
)
TASK_LOG = (
    "task_id string, seq bigint, filename string, status string, result_json string, error string, "
    "created_at timestamp, updated_at timestamp"
)

LINE = (
    "struct<page_index:int,line_index:int,text:string,raw_text:string,confidence:double,bbox:array<double>,"
    "bbox_source:struct<source:string>,bbox_valid:boolean,status:string>"
)
PAGE = (
    f"struct<page_index:int,text:string,raw_text:string,lines:array<{LINE}>,accepted_lines:array<{LINE}>,"
    "layout_mode:string,tables:array<string>,totals:struct<block_count:int,table_count:int>,avg_confidence:double>"
)
QUALITY = (
    "struct<status:string,warnings:array<string>,line_count:bigint,char_count:bigint,avg_confidence:double,"
    "confidence_note:string>"
)
GENERATION = (
    "struct<provider:string,pipeline:string,model_id:string,vllm_base_url:string,device_map:string,"
    "max_new_tokens:int,prompt:string,pdf_dpi:int,max_pdf_pages:int>"
)
RES = (
    "struct<page_count:bigint,final_text:string,raw_text_before_correction:string,selected_variant:string,"
    f"confidence_score:double,layout_mode:string,pages:array<{PAGE}>,tables:array<string>,markdown_text:string,"
    f"quality:{QUALITY},generation:{GENERATION},model_name:string,inference_time_ms:double>"
)
RESULT = f"struct<res:{RES}>"
