"""Typed settings (D14, SRC-8): defaults, then an optional .env file, then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

# The default settings of the document service.
DEFAULT_PROMPT = (
    "Extract all readable text from this document image. Preserve reading order. "
    "Use Markdown for tables. Return only the extracted text."
)
ALLOWED_TYPES = ("image/jpeg", "image/png", "image/webp", "image/tiff", "application/pdf")


#: Names of settings in the environment and in .env; also a field's own name in capitals.
ENV_NAMES = {
    "provider": "QWEN_OCR_PROVIDER", "model_id": "QWEN_OCR_MODEL_ID", "base_url": "QWEN_OCR_VLLM_BASE_URL", "api_key": "QWEN_OCR_VLLM_API_KEY",
    "timeout_s": "QWEN_OCR_VLLM_TIMEOUT", "device_map": "QWEN_OCR_DEVICE_MAP", "torch_dtype": "QWEN_OCR_TORCH_DTYPE",
    "max_new_tokens": "QWEN_OCR_MAX_NEW_TOKENS", "pdf_dpi": "QWEN_OCR_PDF_DPI", "max_pdf_pages": "QWEN_OCR_MAX_PDF_PAGES",
    "low_cpu_mem_usage": "QWEN_OCR_LOW_CPU_MEM_USAGE", "offload_buffers": "QWEN_OCR_OFFLOAD_BUFFERS", "offload_folder": "QWEN_OCR_OFFLOAD_FOLDER",
    "prompt": "QWEN_OCR_PROMPT", "allowed_types": "ALLOWED_IMAGE_TYPES", "task_log_path": "OCR_TASK_DB_PATH",
}
# End of the fixed values.


@dataclass(frozen=True)
class Settings:
    enabled_models: tuple[str, ...] = ("qwen_ocr",)
    provider: str = "vllm"
    model_id: str = "Qwen/Qwen3.6-27B"
    base_url: str = "http://localhost:8000/v1"
    api_key: str = "EMPTY"
    timeout_s: float = 300.0
    device_map: str = "auto"
    torch_dtype: str = "auto"
    max_new_tokens: int = 4096
    pdf_dpi: int = 200
    max_pdf_pages: int = 20
    low_cpu_mem_usage: bool = True
    offload_buffers: bool = True
    offload_folder: str | None = "data/qwen_offload"
    prompt: str = DEFAULT_PROMPT
    max_file_size_mb: int = 20
    allowed_types: tuple[str, ...] = ALLOWED_TYPES
    task_log_path: str = "data/task_log"

    @property
    def max_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, env_file: str | Path | None = None) -> Settings:
        """Empty values count as unset and unknown names are ignored; the environment wins over the file, and a name of
        ENV_NAMES over the bare one. Without arguments the file is .env beside the package."""
        if env is None and env_file is None:
            env_file = Path(__file__).resolve().parents[1] / ".env"
        found = dict(_read_env_file(env_file)) if env_file else {}
        found |= {k.upper(): v for k, v in (os.environ if env is None else env).items() if v != ""}
        values = {}
        for f in fields(cls):
            raw = found.get(ENV_NAMES.get(f.name), "") or found.get(f.name.upper(), "")
            if raw != "":
                values[f.name] = _parse(raw, getattr(cls, f.name))
        return cls(**values)


def _read_env_file(path):
    if not Path(path).exists():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().partition("=")
        value = value.strip().strip("\"'")
        if eq and value and not key.startswith("#"):
            yield key.strip().upper(), value


def _parse(raw, default):
    if isinstance(default, bool):
        if raw.lower() in ("1", "true", "yes", "on"):
            return True
        if raw.lower() in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"not a boolean: {raw!r}")
    if isinstance(default, tuple):
        return tuple(json.loads(raw))
    return type(default)(raw) if default is not None else raw
