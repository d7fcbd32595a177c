"""Spark-native de Bruijn graph analytics: reads to k-mer graph to contigs, and corpus operators in ``helixframe.llm``."""

from helixframe.plans.assembler import Assemble, Assembly, BasicAsm, assemble, assemble_graph
from helixframe.sources.readers import Config, InputFileType, load_config

__all__ = ["Assemble", "Assembly", "BasicAsm", "Config", "InputFileType", "assemble", "assemble_graph", "load_config"]
