"""Entry points that put operators together: the recall dispatcher, gateways, ingest, forge and refine pipelines."""
