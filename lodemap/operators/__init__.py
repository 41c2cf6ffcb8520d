"""lodemap.operators"""
