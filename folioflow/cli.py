"""Batch entry point (SRC-2, SNK-8): prints the text of one file. Nothing is printed for one that can't be read."""

import argparse

from folioflow.operators import assemble, pages, recognize
from folioflow.session import get_spark
from folioflow.settings import Settings
from folioflow.sources.uploads import read_uploads


def text_of(spark, path, settings, recognizer, **decoders) -> str:
    docs = read_uploads(spark, path).withColumnRenamed("upload_id", "task_id")
    texts = recognize.recognize(pages.explode_pages(docs, settings, **decoders), recognizer)
    row = assemble.gather(texts, docs.select("task_id")).select("raw_text", "error").first()
    return row.raw_text if row and row.error is None else ""


def main(argv=None) -> None:
    defaults = Settings.load()
    p = argparse.ArgumentParser(description="Read the text of an image or PDF.")
    p.add_argument("--image-path", "-i", required=True)
    p.add_argument("--provider", default=defaults.provider)
    p.add_argument("--model-id", default=defaults.model_id)
    p.add_argument("--max-new-tokens", type=int, default=defaults.max_new_tokens)
    a = p.parse_args(argv)
    settings = Settings(provider=a.provider, model_id=a.model_id, max_new_tokens=a.max_new_tokens, base_url=defaults.base_url, api_key=defaults.api_key)
    model = recognize.make_recognizer(settings)
    model.load()
    print(text_of(get_spark(), a.image_path, settings, model))
    model.unload()


if __name__ == "__main__":
    main()
