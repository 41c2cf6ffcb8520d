"""lodemap.sources"""
