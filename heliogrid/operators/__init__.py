"""heliogrid.operators"""
