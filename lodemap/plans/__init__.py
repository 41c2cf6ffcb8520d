"""lodemap.plans"""
