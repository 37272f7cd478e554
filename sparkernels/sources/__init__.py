"""Inputs: generators with the kernels' own random streams, views of warehouse tables, and sinks."""
