"""The formula language: parser, null algebra on columns, compiler."""
