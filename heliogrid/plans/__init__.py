"""heliogrid.plans"""
