"""Operations of a training-data pipeline: filtering, de-duplication, scoring and packing of documents."""
